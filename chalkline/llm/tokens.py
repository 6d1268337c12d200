"""Exact, cached use of a public tokenizer file inside Python workers.

``WordIds`` gives the same ids as ``Tokenizer.encode(text, add_special_tokens=False)`` for the
word-level BPE file: white space never reaches a token there, so a text's ids are those of its
chunks between blanks and line breaks, and a chunk is worked out once per worker process.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: The pre-token pattern of the word_bpe_49k file, written for the `regex` module.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks in a worker's cache; fewer take less memory and more time, and the ids are the same.
MAX_CHUNKS = 1_400_000
#: Letters below this code point are their own NFC form and have a lower case free of context.
PLAIN_BELOW = 0x250


class _Codes(dict):
    """chunk -> small integer; a chunk seen first gets the next code and is queued."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.fresh.append(chunk)
        return code


class WordIds:
    """Ids of whole texts; ``max_chunks`` bounds the cache: the chunks met first stay, later ones are
    worked out for the texts at hand and forgotten."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, max_words: int = 100_000) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(PRE_TOKEN)
        self.max_chunks, self.max_words = max_chunks, max_words
        self.codes = _Codes()
        self.passing: list[str] = []
        self.pretokens: dict[str, list[int]] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lens = np.empty(1 << 14, np.int64)
        self.n = 0

    def _learn(self) -> None:
        fresh, self.codes.fresh = self.codes.fresh, []
        known, split, odd, words = self.pretokens, [], {}, set()
        for chunk in fresh:
            if "<|" in chunk or (not chunk.isascii() and ord(max(chunk)) >= PLAIN_BELOW):
                odd[chunk] = None
                split.append(None)
                continue
            lower = chunk.lower()
            parts = [lower] if lower.isalpha() else self.pattern.findall(lower)
            words.update(p for p in parts if p not in known)
            split.append(parts)
        if words:
            words = list(words)
            for word, enc in zip(words, self.words.encode_batch_fast(words, add_special_tokens=False)):
                known[word] = enc.ids
        if odd:
            for chunk, enc in zip(odd, self.full.encode_batch_fast(list(odd), add_special_tokens=False)):
                odd[chunk] = enc.ids
        lens = np.empty(len(fresh), np.int64)
        ids: list[int] = []
        for k, (chunk, parts) in enumerate(zip(fresh, split)):
            before = len(ids)
            if parts is None:
                ids += odd[chunk]
            else:
                for p in parts:
                    ids += known[p]
            lens[k] = len(ids) - before
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts, self.lens = _room(self.starts, self.n + len(fresh)), _room(self.lens, self.n + len(fresh))
        self.lens[self.n : self.n + len(fresh)] = lens
        self.starts[self.n : self.n + len(fresh)] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.n += len(fresh)
        if len(known) > self.max_words:
            for word in words:
                del known[word]
        if len(self.codes) > self.max_chunks:
            self.passing = fresh

    def _forget(self) -> None:
        for chunk in self.passing:
            del self.codes[chunk]
        self.n -= len(self.passing)
        self.used = int(self.starts[self.n]) if self.passing else self.used
        self.passing = []

    def _coded(self, texts: Iterable[str]) -> list[np.ndarray]:
        self._forget()
        code = self.codes.__getitem__
        coded = []
        for text in texts:
            chunks = text.replace("\n", " ").split(" ")
            coded.append(np.fromiter(map(code, chunks), np.int64, len(chunks)))
        if self.codes.fresh:
            self._learn()
        return coded

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out = []
        for codes in self._coded(texts):
            lens = self.lens[codes]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if len(ends) else 0
            at = np.repeat(self.starts[codes] - (ends - lens), lens) + np.arange(total)
            out.append(self.flat[at])
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        return np.array([int(self.lens[c].sum()) for c in self._coded(texts)], np.int64)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    b = np.empty(max(n, 2 * len(a)), a.dtype)
    b[: len(a)] = a
    return b


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and stand beside the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@functools.lru_cache(maxsize=1)
def word_ids(path: str, max_chunks: int = MAX_CHUNKS) -> WordIds:
    """One ``WordIds`` for each Python worker, of the file and the size asked for last."""
    return WordIds(path, max_chunks)
