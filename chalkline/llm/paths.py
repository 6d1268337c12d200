"""Where the public tokenizer files lie; a parameter of every operator that reads one."""

from __future__ import annotations


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
