"""Fill-in-middle: an index of distinct texts with Elias-Fano lists of token boundaries, and seeded cuts.

Tokens are runs of A-Z and a-z, and each other code point. Documents are grouped by text: a task folds equal texts of
a batch by their content, then the digests meet by a shuffle, where a text joins a group only if its bytes are equal.
For each group the boundaries (byte offsets of tokens, and the end) are worked out once and kept as an Elias-Fano
list: low bits in a row, high bits as a unary vector with counts by block, so that the k-th boundary is found
without unpacking the list. The group's documents are then joined back, each selects its two boundaries by its hash.

A text that is frequent in a batch goes to one of many slots, so that a group of copies of any size is dealt over
the tasks; its list is worked out once a slot. Lists of keys hold at most a batch's rows, and results leave in
pieces of bounded size, so memory holds a batch and the longest text.

Defined results: a null text is the empty one; null keys hash as empty ones; repeated rows give repeated results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are cut, and so many of the cut ones have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: A text with so many copies in a batch goes to one of so many slots by batch.
FREQUENT, SLOTS = 8, 256
#: Bytes of results that leave a task at once.
PIECE = 8 << 20
_BLOCK = 64


def elias_fano(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """Low bits a value, and as bytes: low bits, high bits, ones before each block. ``values`` ascend up to ``universe``."""
    n = len(values)
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    lows = np.packbits(((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel(), bitorder="little")
    bits = np.zeros((universe >> low) + n + 1, np.uint8)
    bits[(values >> low) + np.arange(n)] = 1
    highs = np.packbits(bits, bitorder="little")
    ones = np.add.reduceat(np.bitwise_count(highs), np.arange(0, len(highs), _BLOCK), dtype=np.uint32)
    return low, lows.tobytes(), highs.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()


def select(k: int, low: int, lows: bytes, highs: bytes, before: bytes) -> int:
    """The value at place ``k`` of a list made by ``elias_fano``."""
    counts = np.frombuffer(before, "<u4")
    block = int(np.searchsorted(counts, k, "right")) - 1
    bits = np.unpackbits(np.frombuffer(highs, np.uint8)[block * _BLOCK : (block + 1) * _BLOCK], bitorder="little")
    at = block * _BLOCK * 8 + int(np.flatnonzero(bits)[k - int(counts[block])])
    first, last = k * low // 8, (k * low + low + 7) // 8
    rest = int.from_bytes(lows[first:last], "little") >> (k * low - first * 8) & ((1 << low) - 1)
    return (at - k) << low | rest


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets of the tokens of a UTF-8 text, and its end."""
    b = np.frombuffer(text, np.uint8)
    letter = (b | 32) - np.uint8(97) < 26
    first = (b & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(first), len(b))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with equal texts as one, with the list of their keys."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        coded = batch.column(1).dictionary_encode()
        codes, texts = coded.indices.to_numpy(), coded.dictionary
        counts = np.bincount(codes, minlength=len(texts))
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends), batch.column(0).take(pa.array(np.argsort(codes, kind="stable"))))
        slots = np.where(counts >= FREQUENT, 1 + (part * 31 + number) % SLOTS, 0).astype(np.int32)
        digests = pa.array([hashlib.sha256(t.as_buffer()).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([digests, pa.array(slots), texts, keys], ["digest", "slot", "text", "keys"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their digests, each with the list of its text; equal texts share one."""
    digest, lists = None, {}
    for batch in batches:
        made = []
        for d, t in zip(batch.column("digest"), batch.column("text")):
            text = t.as_buffer().to_pybytes()
            if (d := d.as_py()) != digest:
                digest, lists = d, {}
            if text not in lists:
                values = boundaries(text)
                lists[text] = (len(values) - 1, *elias_fano(values, len(text)))
            made.append(lists[text])
        n, *rest = zip(*made) if made else [()] * 5
        columns = [pa.array(x, kind) for x, kind in zip((n, *rest), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("keys"), *columns], ["text", "keys", "n", "low", "lows", "highs", "before"])


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct texts with their lists (n, low, lows, highs, before) and the keys of the documents that have them; a text
    with many documents has several rows."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    folded = rows.mapInArrow(_folded, f"digest binary, slot int, text string, keys array<{kind}>")
    grouped = folded.repartition("digest", "slot").sortWithinPartitions("digest")
    return grouped.mapInArrow(_listed, f"text string, keys array<{kind}>, n bigint, low int, lows binary, highs binary, before binary")


def cut_text(key: str, seed: str, text: bytes, n: int, boundary) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and output of one document; ``boundary(k)`` is the offset of token k."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= CUT or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = boundary(a), boundary(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = h4 % 100 < SUFFIX_FIRST
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return "spm" if spm else "psm", len(prefix.decode()), len(middle.decode()), out


def _cut(seed: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows, keys, size = [], [], 0
            key_type = batch.schema.field("keys").type.value_type
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_buffer().to_pybytes()
                n, low, lows, highs, before = (batch.column(c)[k].as_py() for c in ("n", "low", "lows", "highs", "before"))
                for key in batch.column("keys")[k].as_py():
                    rows.append((n, *cut_text("" if key is None else str(key), seed, text, n, lambda i: select(i, low, lows, highs, before))))
                    keys.append(key)
                    size += len(text) + 64
                    if size >= PIECE:
                        yield _piece(keys, rows, key_type)
                        rows, keys, size = [], [], 0
            if rows:
                yield _piece(keys, rows, key_type)

    return pieces


def _piece(keys: list, rows: list, key_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))]
    output = pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *columns, output], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1") -> DataFrame:
    """For every document its key, n tokens, form, code points of prefix and middle (null if plain), and output."""
    found = index(docs, key, text)
    kind = found.schema["keys"].dataType.elementType.simpleString()
    made = found.mapInArrow(_cut(seed), f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("key", key)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text from form and output: texts that hold a marker are never cut, so each marker stands once."""
    parts = F.split(output, "<[PSM]>", 4)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
