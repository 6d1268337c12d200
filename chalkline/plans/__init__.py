"""Registered queries by subject; importing this package registers all of them."""

from chalkline.plans import control, files, latency, retrieval, sequences, streams, texts, words

__all__ = ["control", "files", "latency", "retrieval", "sequences", "streams", "texts", "words"]
