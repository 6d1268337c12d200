"""Packing of tokenised documents into fixed windows by non-negative least squares.

Each task packs the documents of its own input split in bounded chunks, so nothing is shuffled and
no task holds more than a chunk. Per chunk: whole windows of a long document are sequences of their
own; the remainders' lengths form a histogram; all shallow combinations of length bins that fill a
window are enumerated; non-negative least squares gives how often each is used; the counts are
rounded down; what is left over is packed greedily, cut to fill the gaps. The last, short sequence
of a task is cut at powers of two, so it needs no padding.

Defined results: a null text is an empty document (its end id only); repeated rows and null
doc_ids are packed like any others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.tokens import MAX_CHUNKS

WINDOW = 2048
#: Histogram bins in a window, most pieces in a combination, share of remainders kept for the gaps.
BINS, DEPTH, SPARE = 32, 3, 0.08
#: A chunk ends after so many documents or tokens.
CHUNK_DOCS, CHUNK_TOKENS = 8192, 8_000_000

PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("ids", T.BinaryType())]
)


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, ab = a.T @ a, a.T @ b
    for _ in range(steps):
        slope = ab - gram @ x
        slope[free] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, abs(ab).max()):
            break
        free[k] = True
        while True:
            on = np.flatnonzero(free)
            z = np.zeros(n)
            z[on] = np.linalg.lstsq(gram[np.ix_(on, on)], ab[on], rcond=None)[0]
            if z[on].min() > 0:
                x = z
                break
            bad = on[z[on] <= 0]
            gap = x[bad] - z[bad]
            step = float(np.min(np.where(gap > 0, x[bad] / np.where(gap > 0, gap, 1), 0)))
            x = np.maximum(x + step * (z - x), 0)
            free[bad[x[bad] <= 1e-12]] = False
            if free[bad].all():
                free[bad[np.argmin(x[bad])]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


@functools.lru_cache(maxsize=8)
def combinations(bins: int, depth: int) -> np.ndarray:
    """Columns: the bins (by upper end) of at most ``depth`` pieces that fill a window exactly."""
    found = []
    for d in range(1, depth + 1):
        for c in itertools.combinations_with_replacement(range(1, bins + 1), d):
            if sum(c) == bins:
                found.append(np.bincount(np.array(c) - 1, minlength=bins))
    return np.array(found, float).T


def plan(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) that together hold each id just once."""
    sequences: list[list[tuple[int, int, int]]] = []
    whole, rest = np.divmod(lengths, window)
    for k in np.flatnonzero(whole):
        sequences += [[(int(k), i * window, window)] for i in range(int(whole[k]))]
    width = -(-window // min(BINS, window))
    bins = window // width  # their ends are within the window; what is longer stands alone in the last one
    members: list[list[int]] = [[] for _ in range(bins)]
    for k in np.flatnonzero(rest):
        members[min(bins, -(-int(rest[k]) // width)) - 1].append(int(k))
    spare: list[int] = []
    for m in members:  # of each bin, some stay to fill gaps with
        keep = int(np.ceil(len(m) * SPARE))
        spare += m[:keep]
        del m[:keep]
    combos = combinations(bins, DEPTH)
    times = nnls(combos, np.array([len(m) for m in members], float)) if any(members) else np.zeros(combos.shape[1])
    made: list[tuple[list[tuple[int, int, int]], int]] = []
    for c, count in zip(combos.T.astype(int), np.floor(times + 1e-9).astype(int)):
        used = np.flatnonzero(c)
        for _ in range(min([int(count), *(len(members[b]) // c[b] for b in used)])):
            docs = [members[b].pop() for b in used for _ in range(c[b])]
            made.append(([(k, int(whole[k]) * window, int(rest[k])) for k in docs], window - int(sum(rest[k] for k in docs))))
    left = [(k, int(whole[k]) * window, int(rest[k])) for k in spare + [k for m in members for k in m]]
    left.sort(key=lambda p: -p[2])
    for pieces, gap in made:
        while gap and left:
            k, start, n = left.pop()
            take = min(n, gap)
            pieces.append((k, start, take))
            if take < n:
                left.append((k, start + take, n - take))
            gap -= take
        sequences.append(pieces)
    row: list[tuple[int, int, int]] = []
    room = window
    total = sum(p[2] for p in left)
    for k, start, n in reversed(left):
        while n:
            if room == window and total < window:  # the end: powers of two need no padding
                room = 1 << (total.bit_length() - 1)
            take = min(n, room)
            row.append((k, start, take))
            start, n, room, total = start + take, n - take, room - take, total - take
            if not room:
                sequences.append(row)
                row, room = [], window
    return sequences


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, with_ids: bool = True, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all ``docs``.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers (null unless ``with_ids``).
    ``max_chunks`` bounds the cache of the tokenizer in a worker; it changes time and memory, never rows.
    ``sequence_id`` is made of the task's number and a count, so a task that runs anew gives the same.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.tokens import give_back, word_ids

        coder = word_ids(tokenizer, max_chunks)
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([end_id], np.uint32)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            lengths = np.array([len(x) for x in ids], np.int64)
            rows: list[tuple] = []
            for pieces in plan(lengths, window):
                at = 0
                for k, start, n in pieces:
                    part = ids[k][start : start + n].astype("<u4", copy=False).tobytes()
                    rows.append((keys[k], start, n, zlib.crc32(part), len(ids[k]), sequence, at, part if with_ids else None))
                    at += n
                sequence += 1
            keys.clear()
            ids.clear()
            held = 0
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i : i + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.binary())], PIECES.names)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, got in zip(part.column(0).to_pylist(), coder.ids(texts)):
                    keys.append(key)
                    ids.append(np.concatenate([got, end]))
                    held += len(got) + 1
                if len(keys) >= CHUNK_DOCS or held >= CHUNK_TOKENS:
                    yield from emit()
        if keys:
            yield from emit()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, PIECES)
