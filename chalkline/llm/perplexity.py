"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, and per-document perplexity.

Word pairs of the training half of the trusted documents are counted in sorted blocks per task, which meet in shards by
first word. All pairs are in the model, with the three discounts of their counts; words have the discounts of their
numbers of left neighbours, and are interpolated with the uniform distribution. A document's log probability is then
a sum of values of its words and word pairs, with 0 for what the model lacks:

    sum over words of log P(w) - log P(unknown) + log backoff(w), over known pairs of
    log P(w | v) - log backoff(v) - log P(w), and a constant for each word.

So it is found by one join of counts by shard. The values of the most frequent words and pairs, ``HEAD`` at most of
each, are with every task; tasks send the documents' other words and pairs to the shard of their hash, where they meet
the model's values, and the parts of a document's sum are added up. A pair goes by its own hash if its last word is
a frequent one, so no word makes a hot shard; else by its last word, whose P(w) is in that shard. Each shard is dealt
in as many salts as the volume of documents asks for, and the model's part is sent to each of them.

Words are 48-bit hashes (of 10^8 words some 20 pairs agree). Keys have ``SPARE_BITS`` bits more than the number of pairs
in the model needs, so a word or pair that the model lacks gets the value of another with a chance of 2^-16. Documents less likely than
``QUANTILE`` of the other half of the trusted ones of their language are rejected.

Defined results: a text without words (null, empty) has null perplexity and is not kept; rows without
trusted text at all are kept if they have words; a language without trusted text has the threshold of
all languages; repeated rows get equal results; null ids are scored but never trusted. Memory follows ``BLOCK_TOKENS``, or
the longest text if that has more words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.batches import small_batches
from chalkline.llm.jaccard import word_hashes
from chalkline.llm.tokens import give_back
from chalkline.session import ensure_checkpoint_dir

#: Share of held-out trusted documents of a language that its threshold accepts.
QUANTILE = 0.99
#: Most words, and most pairs, whose values are broadcast (some 20 bytes each).
HEAD = 1 << 18
#: Bits of a key beyond those that tell the model's pairs apart.
SPARE_BITS = 16
#: Texts that a task hands to Python at once, and rows of the model that it sends at once.
BATCH_ROWS, GATHERED = 3000, 200_000
#: More trusted ids than this are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Words of a block; pairs that a shard counts, values that it holds, and characters of documents for each of its salts.
BLOCK_TOKENS, SHARD_PAIRS, SHARD_VALUES, SALT_CHARS = 1_500_000, 2_000_000, 2_000_000, 200_000_000
_BEGIN, _END = np.uint64(1), np.uint64(2)  # stand for the borders of a text
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COUNTED = "shard int, firsts binary, seconds binary, ns binary"
_PAIRS = "v long, w long, n long, seen long, one long, two long, more long"
_MOVED = "shard int, salt int, kind int, keys binary, vals binary, words binary, sizes binary, docs binary, counts binary, ids binary"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _squeezed(blob: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob if isinstance(blob, bytes) else blob.tobytes())


def _opened(blob: bytes, of: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), of)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_keys(words: np.ndarray) -> np.ndarray:
    return _mixed(words * _STEP + np.uint64(1))


def _pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(v * _STEP) + w * np.uint64(0xD1342543DE82EF95))


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with ``BLOCK_TOKENS`` words at most, or one text."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
        at, before = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, min(int(np.searchsorted(ends, before + BLOCK_TOKENS, "right")), at + 65_535))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of several batches as one, ``GATHERED`` at least: sorted keys that stand closer take less space."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _bordered(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit word hashes with a border before and after each text; lengths with both borders."""
    lens = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(16)
    out = np.empty(len(flat) + 2 * len(lens), np.uint64)
    ends = np.cumsum(lens + 2)
    out[ends - 1] = _END
    out[ends - lens - 2] = _BEGIN
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - lens - 2] = False
    out[inner] = np.maximum(flat, np.uint64(3))
    return out, lens + 2


def _pairs(tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second word of each pair, and the text that each is of."""
    owner = np.repeat(np.arange(len(lens)), lens)
    inside = owner[1:] == owner[:-1]
    return tokens[:-1][inside], tokens[1:][inside], owner[1:][inside]


def _planes(keys: np.ndarray) -> bytes:
    """Steps between sorted keys, byte place by byte place: the high places are zeros that compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _power_of_two(n: float) -> int:
    return 1 << max(4, int(np.ceil(np.log2(max(1.0, n)))))


def pair_counts(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(v, w, n, seen, one, two, more) over ``docs`` (words array of hashes): how often w follows v; for v, how many words
    follow it, and how many different ones once, twice and more often."""
    shift = np.uint64(64 - int(np.log2(shards)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 0):
            v, w, _ = _pairs(*_bordered(block.column(0)))
            _, first, n = np.unique(_pair_keys(v, w), return_index=True, return_counts=True)
            v, w = v[first], w[first]
            while (n > 255).any():  # a count that does not fit goes in several entries
                big = np.flatnonzero(n > 255)
                v, w = np.append(v, v[big]), np.append(w, w[big])
                n = np.append(n, n[big] - 255)
                n[big] = 255
            shard = _word_keys(v) >> shift
            order = np.lexsort((w, v, shard))
            v, w, n, shard = v[order], w[order], n[order].astype(np.uint8), shard[order]
            edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            rows = [
                (k, _squeezed(_planes(v[a:z])), _squeezed(w[a:z].view(np.uint8).reshape(-1, 8)[:, :6].T), _squeezed(n[a:z]))
                for k, (a, z) in enumerate(zip(edges[:-1], edges[1:])) if z > a
            ]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "firsts", "seconds", "ns"])
        give_back()

    def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        v, w, n = (np.concatenate(x) for x in zip(*parts))
        _, first, group = np.unique(_pair_keys(v, w), return_index=True, return_inverse=True)
        n = np.bincount(group, n).astype(np.int64)
        v, w = v[first], w[first]
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        _, at = np.unique(v, return_inverse=True)
        of = [np.bincount(at, x).astype(np.int64)[at] for x in (n, n == 1, n == 2, n > 2)]
        for k in range(0, len(v), 200_000):
            part = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part].view(np.int64)) for x in (v, w, n, *of)], ["v", "w", "n", "seen", "one", "two", "more"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for b in batches:
            for k, firsts, seconds, ns in zip(*(c.to_pylist() for c in b.columns)):
                if k != shard and parts:
                    yield from summed(parts)
                    parts = []
                shard = k
                n = _opened(ns).astype(np.int64)
                w = np.zeros((len(n), 8), np.uint8)
                w[:, :6] = _opened(seconds).reshape(6, -1).T
                parts.append((_from_planes(_opened(firsts)), w.view(np.uint64).ravel(), n))
        if parts:
            yield from summed(parts)
        give_back()

    moved = docs.select("words").mapInArrow(counted, _COUNTED)
    return moved.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merged, _PAIRS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts of one, two, and three or more; where counts are lacking, half of the count, as far as that."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    found = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


class Model:
    """Pairs and words as stored tables, and the numbers that turn their counts into probabilities."""

    def __init__(self, pairs: DataFrame) -> None:
        self.pairs = _stored(pairs, "pairs")
        by_count = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
        c = self.pairs.agg(*by_count, F.count(F.lit(1)).alias("size")).first()
        self.size, self.cuts = c["size"], discounts(c.n1, c.n2, c.n3, c.n4)
        words = _stored(self.pairs.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
        u = words.agg(*by_count, F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("size"), F.count_if(F.col("n") > 2).alias("above")).first()
        low, total = discounts(u.n1, u.n2, u.n3, u.n4), u.total or 1
        rest = (low[0] * u.n1 + low[1] * u.n2 + low[2] * u.above) / total if u.total else 1.0
        self.unknown = rest / (u["size"] + 1)
        of = F.when(F.col("n") == 1, low[0]).when(F.col("n") == 2, low[1]).otherwise(low[2])
        lower = words.select("w", F.col("n").alias("left"), ((F.col("n") - of) / total + self.unknown).alias("p"))
        contexts = self.pairs.groupBy("v").agg(*[F.max(x).alias(x) for x in ("seen", "one", "two", "more")])
        left = self.cuts[0] * F.col("one") + self.cuts[1] * F.col("two") + self.cuts[2] * F.col("more")
        contexts = contexts.select("v", "seen", (left / F.col("seen")).alias("backoff"))
        value = F.log(F.coalesce("p", F.lit(self.unknown))) - float(np.log(self.unknown)) + F.coalesce(F.log("backoff"), F.lit(0.0))
        self.words = _stored(
            lower.join(contexts, lower.w == contexts.v, "full").select(
                F.coalesce("w", "v").alias("word"), F.coalesce("p", F.lit(self.unknown)).alias("p"), value.alias("val"), 
                # the border behind each text is followed by nothing, yet as frequent as any word
                F.when(F.coalesce("w", "v") == int(_END), F.lit(1 << 40)).otherwise(F.greatest(F.coalesce("seen", F.lit(1)), F.coalesce("left", F.lit(1)))).alias("n"),
            ),
            "units",
        )

    def ratio(self, n: np.ndarray, seen: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> np.ndarray:
        """(n - discount) / (seen x backoff) of pairs: P(w | v) / (backoff(v) P(w)) is 1 and this over P(w)."""
        cut_off = np.array([0.0, *self.cuts])[np.minimum(n, 3)]
        return (n - cut_off) / (np.array(self.cuts) @ np.array([one, two, more], float))

    def __getstate__(self) -> dict:  # tasks need the numbers only
        return {"cuts": self.cuts, "unknown": self.unknown}


def train(docs: DataFrame, shards: int = 16) -> Model:
    return Model(pair_counts(docs, shards))


def _level_of_head(df: DataFrame) -> int:
    """Least ``4 log2 n`` of the ``HEAD`` most frequent rows; in whole steps, so their sizes fit in some 250 rows."""
    lowest, taken = 1 << 20, 0
    for r in df.groupBy(F.floor(4 * F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect():
        taken += r["count"]
        if taken > HEAD:
            break
        lowest = r["level"]
    return lowest


def _columns(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[place] == keys, place


def _head(model: Model) -> tuple[list[np.ndarray], tuple[int, int]]:
    """([words, their P, their values, pair keys, their values], levels): what every task has."""
    frequent = lambda df, level: df.where(F.floor(4 * F.log2("n")) >= level)
    level, pair_level = _level_of_head(model.words), _level_of_head(model.pairs)
    words, p, vals = _columns(frequent(model.words, level).select("word", "p", "val"))
    order = np.argsort(words.view(np.uint64))
    words, p, vals = words.view(np.uint64)[order], p[order], vals[order].astype(np.float32)
    v, w, *counts = _columns(frequent(model.pairs, pair_level))
    known, at = _found(words, w.view(np.uint64))
    keys = _pair_keys(v.view(np.uint64), w.view(np.uint64))[known]
    pair_vals = np.log1p(model.ratio(*(c[known] for c in counts)) / p[at[known]]).astype(np.float32)
    order = np.argsort(keys)
    return [words, p, vals, keys[order], pair_vals[order]], (level, pair_level)


def scores(docs: DataFrame, model: Model, chars: int = 0) -> DataFrame:
    """(key, part): of each document (key, words) the sum of the model's values; ``chars``: size of all documents."""
    spark = docs.sparkSession
    arrays, (level, _) = _head(model)
    head = spark.sparkContext.broadcast(arrays)
    shards = _power_of_two(model.size / SHARD_VALUES)
    salts = max(1, -(-chars // (shards * SALT_CHARS)))
    shard_bits = np.uint64(int(np.log2(shards)))
    key_shift = np.uint64(max(0, 64 - SPARE_BITS - int(np.ceil(np.log2(model.size + 2)))))
    numbers = model.__getstate__()
    fields = [("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("keys", "vals", "words", "sizes", "docs", "counts", "ids")]]

    def row(shard, salt, kind, **blobs):
        return {"shard": shard, "salt": salt, "kind": kind} | {k: _squeezed(v) for k, v in blobs.items()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    def of_shards(shard: np.ndarray) -> list[tuple[int, int, int]]:
        edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        return [(k, int(a), int(z)) for k, (a, z) in enumerate(zip(edges[:-1], edges[1:]))]

    def shard_of(keys: np.ndarray) -> np.ndarray:
        return keys >> (np.uint64(64) - shard_bits)

    def pair_shards(keys: np.ndarray, w: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        return np.where(frequent, shard_of(keys), shard_of(_word_keys(w)))

    def sent(shard: np.ndarray, kind: int, keys: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((keys, shard))
        parts, keys = of_shards(shard[order]), keys[order]
        columns = {n: c[order] for n, c in columns.items()}
        return batch_of([row(k, t, kind, keys=_planes(keys[a:z]), **{n: c[a:z] for n, c in columns.items()}) for k, a, z in parts if z > a for t in range(salts)])

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            words, p, vals = (c.to_numpy() for c in b.columns)
            keys = _word_keys(words.view(np.uint64))
            yield sent(shard_of(keys), 0, keys=keys >> key_shift, words=words, vals=np.stack([vals, p], 1).astype(np.float32))

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, p, _, head_keys, _ = head.value
        of = Model.__new__(Model)
        of.__dict__.update(numbers)
        for b in _gathered(batches):
            v, w, *counts = (c.to_numpy() for c in b.columns)
            v, w = v.view(np.uint64), w.view(np.uint64)
            keys = _pair_keys(v, w)
            ratio = of.ratio(*counts)
            frequent, at = _found(words, w)
            vals = np.where(frequent, np.log1p(ratio / p[at] if len(p) else ratio), ratio).astype(np.float32)
            rest = ~_found(head_keys, keys)[0]
            shard = pair_shards(keys, w, frequent)
            for kind, some in ((1, rest & frequent), (2, rest & ~frequent)):
                if some.any():
                    more = {"words": w[some]} if kind == 2 else {}
                    yield sent(shard[some], kind, keys=keys[some] >> key_shift, vals=vals[some], **more)

    def send_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _, word_vals, head_keys, head_vals = head.value
        for block in _blocks(batches, 1):
            tokens, lens = _bordered(block.column(1))
            local, shard, keys, owner = np.zeros(len(lens)), [], [], []
            docs_of = np.repeat(np.arange(len(lens)), lens)
            hit, place = _found(words, tokens)
            local += np.bincount(docs_of[hit], word_vals[place[hit]], len(lens))
            mine = _word_keys(tokens[~hit])
            shard, keys, owner = [shard_of(mine)], [mine], [docs_of[~hit]]
            inside = docs_of[1:] == docs_of[:-1]
            v, w, frequent, docs_of = tokens[:-1][inside], tokens[1:][inside], hit[1:][inside], docs_of[1:][inside]
            mine = _pair_keys(v, w)
            hit, place = _found(head_keys, mine)
            local += np.bincount(docs_of[hit], head_vals[place[hit]], len(lens))
            keep = ~hit
            shard.append(pair_shards(mine[keep], w[keep], frequent[keep]))
            keys.append(mine[keep])
            owner.append(docs_of[keep])
            shard, keys, owner = np.concatenate(shard), np.concatenate(keys) >> key_shift, np.concatenate(owner).astype(np.uint16)
            del v, w, mine, hit, place, keep, tokens, docs_of
            order = np.lexsort((owner, keys, shard))
            shard, keys, owner = shard[order], keys[order], owner[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(keys)))
            while (counts > 255).any():  # a count that does not fit goes in several entries
                big = np.flatnonzero(counts > 255)
                first, rest = np.insert(first, big, first[big]), counts[big] - 255
                counts[big] = rest
                counts = np.insert(counts, big, 255)
            shard, keys, owner = shard[first], keys[first], owner[first]
            ids = block.column(0).to_numpy()
            salt = int(_mixed(ids[:1].view(np.uint64))[0] % np.uint64(salts))
            rows = []
            for k, a, z in of_shards(shard):
                asked, starts = np.unique(keys[a:z], return_index=True)
                sizes = np.diff(np.append(starts, z - a)).astype(np.uint32)
                # a shard gets the ids of the documents that ask it; the first one gets all, and what the head gave them
                here = np.arange(len(ids)) if k == 0 else np.unique(owner[a:z])
                vals = local if k == 0 else np.empty(0)
                docs_here = np.searchsorted(here, owner[a:z]).astype(np.uint16)
                if len(here):
                    rows.append(row(k, salt, 3, keys=_planes(asked), vals=vals, words=b"", sizes=sizes, docs=docs_here.view(np.uint8).reshape(-1, 2).T, counts=counts[a:z].astype(np.uint8), ids=ids[here]))
            yield batch_of(rows)
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        at, keys, vals = None, None, None

        def ready() -> tuple[np.ndarray, np.ndarray]:
            """The shard's keys and values; rare words' P turns the ratios of pairs that end in them into values."""
            numbers_of = lambda kind, name, of: np.concatenate([np.empty(0, of), *(_opened(r[name], of) for r in held.get(kind, []))])
            pair = np.concatenate([np.empty((0, 2), np.float32), *(_opened(r["vals"], np.float32).reshape(-1, 2) for r in held.get(0, []))])
            words = numbers_of(0, "words", np.uint64)
            order = np.argsort(words)
            there, place = _found(words[order], numbers_of(2, "words", np.uint64))
            p = np.where(there, pair[order, 1][place] if len(order) else 1, numbers["unknown"])
            k = np.concatenate([np.empty(0, np.uint64), *(_from_planes(_opened(r["keys"])) for kind in (0, 1, 2) for r in held.get(kind, []))])
            v = np.concatenate([pair[:, 0], numbers_of(1, "vals", np.float32), np.log1p(numbers_of(2, "vals", np.float32) / p)])
            order = np.argsort(k)
            return k[order], v[order].astype(np.float32)

        for b in batches:
            for r in b.to_pylist():
                if (r["shard"], r["salt"]) != at:
                    at, held, keys = (r["shard"], r["salt"]), {}, None
                if r["kind"] < 3:
                    held.setdefault(r["kind"], []).append(r)
                    continue
                if keys is None:
                    keys, vals = ready()
                    held = {}
                asked, ids = _from_planes(_opened(r["keys"])), _opened(r["ids"], np.int64)
                hit, place = _found(keys, asked)
                val = np.where(hit, vals[place] if len(vals) else 0.0, 0.0)
                each = np.repeat(val, _opened(r["sizes"], np.uint32).astype(np.int64)) * _opened(r["counts"])
                docs_here = _opened(r["docs"]).reshape(2, -1).T.copy().view(np.uint16).ravel()
                part = np.bincount(docs_here, each, len(ids)).astype(float)
                if r["shard"] == 0:
                    part += _opened(r["vals"], float)
                copies = np.full(len(ids), int(r["shard"] == 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part), pa.array(copies)], ["key", "part", "copies"])
        give_back()

    rare = model.words.where(F.floor(4 * F.log2("n")) < level).select("word", "p", "val")
    moved = rare.mapInArrow(send_words, _MOVED).unionByName(model.pairs.mapInArrow(send_pairs, _MOVED)).unionByName(docs.select("key", "words").mapInArrow(send_docs, _MOVED))
    place = ["shard", "salt"]
    met = moved.repartition(shards * salts, *place).sortWithinPartitions(*place, "kind").mapInArrow(meet, "key long, part double, copies long")
    return met.groupBy("key").agg((F.sum("part") / F.sum("copies")).alias("part"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) of each row; ``trusted`` has trusted doc_ids.

    Trusted ids are halved by hash: one half trains the model, the other sets the thresholds.
    """
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64("doc_id", "text").alias("key"),
        F.expr(word_hashes("lower(cast(text as string))")).alias("words"),
    )
    half = F.pmod(F.xxhash64("_id"), F.lit(2))
    learned = ids.where(half == 0)
    sized = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.length(F.col("text").cast("string")).alias("n"))
    chars = sized.join(learned, F.col("_doc") == F.col("_id"), "left").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("_id").isNotNull(), F.col("n"))).alias("learned")).first()
    with small_batches(docs.sparkSession, BATCH_ROWS):
        model = train(rows.join(learned, rows.doc_id == F.col("_id")), _power_of_two((chars.learned or 0) / 5 / SHARD_PAIRS))
    unknown = float(np.log(model.unknown))
    got = scores(rows, model, chars["all"] or 0)
    sized = rows.select("doc_id", "lang", "key", F.size("words").cast("long").alias("n_words"))
    scored = sized.join(got, "key").select(
        "doc_id", "lang", "n_words",
        F.when(F.col("n_words") > 0, F.exp(-(F.col("part") + (F.col("n_words") + 1) * unknown) / (F.col("n_words") + 1))).alias("perplexity"),
    )
    with small_batches(docs.sparkSession, BATCH_ROWS):
        scored = _stored(scored, "scored")
    held = scored.join(ids.where(half == 1), scored.doc_id == F.col("_id"))
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    overall = held.agg(limit.alias("overall"))
    by_lang = held.groupBy("lang").agg(limit.alias("own"))
    by_lang = by_lang.withColumnRenamed("lang", "_lang")
    out = scored.join(by_lang, scored.lang.eqNullSafe(by_lang["_lang"]), "left").join(F.broadcast(overall))
    threshold = F.coalesce("own", "overall", F.lit(float("inf")))
    return out.select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), (F.coalesce(F.col("perplexity") <= threshold, F.lit(False))).alias("kept"))
