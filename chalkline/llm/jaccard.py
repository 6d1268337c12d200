"""Similarity join of documents on sets of word n-grams: MinHash banding, then full verification.

Rows of a set meet in buckets of equal band hashes; bands and rows per band follow from the target
recall. A bucket's members are compared on their full n-gram sets, each pair in the first bucket that
it shares. Copies count as one set with a size, so they are never paired with each other. A large
bucket is dealt in pairs of blocks, and a task gives back one row for each member (its links, and the
smallest member it is joined to), never the pairs themselves. Groups are the connected parts.

Defined results: one row for each input row. A text of one to four words has one n-gram, all of it; a
text without words (null, empty, white space) has none and links to nothing. A row without an id stands
alone, with null class. Repeated rows are copies of each other and count as links. Similarity 0.8 itself
is a link. An empty table gives no rows. Only the id and the text are read, so columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.batches import small_batches
from chalkline.llm.tokens import give_back
from chalkline.session import LEAST_FILES, cut

#: Most members of a block; a bucket of more is dealt in pairs of blocks.
BLOCK = 512
#: Texts that a task hands to Python at once.
BATCH_ROWS = 1000
#: Splits of the documents, or parts of a shuffle, that are written to one checkpoint file: each file costs its executor
#: some forks, for whose instant its memory counts twice.
TOGETHER = 3
#: Most rows to drop that are broadcast; more meet the documents by a shuffle.
BROADCAST_ROWS = 1_000_000
_SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("set_id", T.LongType()),
        T.StructField("second", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
_LINKS = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("root", T.LongType()), T.StructField("links", T.LongType())])


def choose_bands(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands that catch a pair of similarity ``threshold`` with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


def word_hashes(text: str) -> str:
    """SQL: 64-bit hashes of the words of a text column."""
    return f"transform(array_remove(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), ''), x -> xxhash64(x))"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(words: pa.ListArray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams (all its words if fewer than ``n``)."""
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.uint64, copy=False)
    ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
        for k in range(n):
            rolled = rolled * step + flat[k : k + len(rolled)]
        rolled = _mixed(rolled)
        out, start = [], 0
        for end in ends.tolist():
            if end - start >= n:
                out.append(np.unique(rolled[start : end - n + 1]))
            else:
                one = np.full(min(end - start, 1), end - start, np.uint64)
                for w in flat[start:end]:
                    one = _mixed(one * step + w)
                out.append(one)
            start = end
    return out


def _sketcher(n: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(20240229)
        masks = draw.integers(0, 1 << 63, bands * rows, np.int64).astype(np.uint64)
        factors = draw.integers(0, 1 << 63, bands * rows, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(2), n)
                full = [k for k, s in enumerate(sets) if len(s)]
                ids, second = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                hashes = np.zeros((len(full), bands), np.uint64)
                if full:
                    flat = np.concatenate([sets[k] for k in full])
                    starts = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
                    with np.errstate(over="ignore"):
                        ids[full] = _mixed(np.add.reduceat(_mixed(flat), starts) + np.uint64(1))
                        second[full] = np.add.reduceat(_mixed(flat ^ np.uint64(0xA0761D6478BD642F)), starts)
                        for b in range(bands):
                            band = np.full(len(full), b + 1, np.uint64)
                            for k in range(b * rows, (b + 1) * rows):
                                low = np.minimum.reduceat((flat ^ masks[k]) * factors[k], starts)
                                band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + low)
                            hashes[:, b] = band
                lens = np.zeros(len(sets), np.int64)
                lens[full] = bands
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(hashes.ravel().view(np.int64)))
                known = pa.array(ids.view(np.int64), mask=lens == 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), known, pa.array(second.view(np.int64)), lists], _SKETCH.names)
        give_back()

    return sketch


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[inverse]
    keep = shared[inverse]
    column, owner = column[keep], owner[keep]
    total = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        if edges[k] < edges[k + 1]:
            x = np.zeros((m, width), np.float32)
            x[owner[part], column[part] - k * width] = 1
            total += x @ x.T
    return total


def _parts(near: np.ndarray) -> np.ndarray:
    """Smallest member of each member's connected part."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label, len(near)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verifier(n: int, threshold: float):
    def compare(rows: list[tuple]) -> list[tuple[int, int, int]]:
        members = list({r[3]: r for r in rows}.values())
        if len(members) < 2:
            return []
        bucket, left, right = members[0][:3]
        sets = shingle_sets(pa.array([r[7] for r in members], pa.list_(pa.int64())), n)
        lens = np.array([len(s) for s in sets], np.float32)
        common = _common(sets)
        near = common * (1 + threshold) >= threshold * (lens[:, None] + lens[None, :]) - 1e-3
        if left != right:
            side = np.array([r[4] for r in members])
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        if near.any():  # pairs that an earlier bucket has too are of that one; buckets of one member here are of no pair
            times = Counter(k for r in members for k in set(r[6]) if k < bucket)
            earlier = sorted(k for k, n in times.items() if n > 1)
            for part in range(0, len(earlier), 2048):
                at = {k: i for i, k in enumerate(earlier[part : part + 2048])}
                x = np.zeros((len(members), len(at)), np.float32)
                for i, r in enumerate(members):
                    x[i, [at[k] for k in r[6] if k in at]] = 1
                near &= (x @ x.T) == 0
        if not near.any():
            return []
        links = near @ np.array([r[5] for r in members], np.int64)
        root = _parts(near)
        return [(members[i][3], members[root[i]][3], int(links[i])) for i in np.flatnonzero(near.any(1))]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple[int, int, int]] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() if k < 7 else c for k, c in enumerate(batch.columns)]):
                if group and row[:3] != group[0][:3]:
                    found += compare(group)
                    group = []
                group.append((*row[:7], row[7].values.to_numpy(zero_copy_only=False)))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], _LINKS.names)
                found = []
        if group:
            found += compare(group)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], _LINKS.names)
        give_back()

    return verify


def connected(edges: DataFrame) -> DataFrame:
    """(node, part): for edges (a, b) each node's smallest connected node, by label spreading with jumps."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    n = both.count()
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("part")), rows=n)
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("_n")).agg(F.min("part").alias("_p"))
        low = labels.join(heard, labels.node == heard["_n"], "left").select("node", F.col("part").alias("_was"), F.least("part", "_p").alias("_p"))
        jump = labels.select(F.col("node").alias("_n"), F.col("part").alias("_j"))
        new = cut(low.join(jump, low["_p"] == jump["_n"], "left").select("node", F.least("_p", "_j").alias("part"), "_was"), rows=n)
        changed = new.where("part <> _was").limit(1).count()
        labels = new.select("node", "part")
        if not changed:
            return labels


def labelled(docs: DataFrame, key: str, text: str, words: int, threshold: float, recall: float) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links) of each row.

    A set is named by a 64-bit hash of its n-grams. A second hash shows names that different sets share, of which
    some are to be expected in 10^10 sets; those sets are named anew by both.
    """
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = source.select("doc_id", F.xxhash64("text").alias("text_hash"), F.expr(word_hashes("text")).alias("words"))
    files = lambda n: max(LEAST_FILES, n // TOGETHER)
    with small_batches(docs.sparkSession, BATCH_ROWS):
        sketches = cut(sketches.mapInArrow(_sketcher(words, bands, rows), _SKETCH).coalesce(files(source.rdd.getNumPartitions())))
    twins = sketches.groupBy("set_id").agg(F.min("second").alias("_low"), F.max("second").alias("_high")).where("_low <> _high").select("set_id")
    n_rows = sketches.count()
    if not (twins := cut(twins, rows=0)).isEmpty():
        sketches = sketches.join(twins.withColumn("_twin", F.lit(True)), "set_id", "left")
        sketches = sketches.withColumn("set_id", F.when(F.col("_twin"), F.xxhash64("set_id", "second")).otherwise(F.col("set_id"))).drop("_twin")
    named = sketches.where("doc_id is not null and set_id is not null").drop("second")
    sets = named.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("size"))
    sets = cut(sets.select("set_id", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "size"), rows=n_rows)

    seats = named.select("set_id", F.explode("bands").alias("bucket")).distinct()
    buckets = seats.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(7), "set_id")).alias("_y")
    )
    buckets = buckets.where("n > 1").groupBy("n", "_x", "_y").agg(F.min("bucket").alias("bucket"))  # one of those with the same members
    seated = seats.join(buckets.select("bucket", "n"), "bucket").groupBy("set_id").agg(F.collect_list(F.struct("bucket", "n")).alias("seats"))
    wanted = seated.join(sets, "set_id")

    texts = source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    dealt = wanted.join(texts, ["doc_id", "text_hash"]).select(
        "set_id", "size", F.col("seats.bucket").alias("mine"), F.expr(word_hashes("text")).alias("words"), F.explode("seats").alias("seat")
    )
    dealt = dealt.withColumn("blocks", F.ceil(F.col("seat.n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.col("seat.bucket").alias("bucket"), F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
        "set_id", "own", "size", "mine", "words",
    )
    place = ["bucket", "left", "right"]
    with small_batches(docs.sparkSession, BATCH_ROWS):
        found = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(_verifier(words, threshold), _LINKS)
        found = cut(found.coalesce(files(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    parts = connected(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    grouped = parts.join(sets, parts.node == sets.set_id)
    lowest = grouped.groupBy("part").agg(F.min("doc_id").alias("lowest"))
    linked = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = cut(
        sets.join(parts, sets.set_id == parts.node, "left").join(lowest, "part", "left").join(linked, "set_id", "left")
        .select("set_id", F.coalesce("lowest", "doc_id").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), rows=n_rows,
    )
    # rows without an id or words stay out of the join, where null would be one hot key; the join splits a set of many copies
    alone = F.col("doc_id").isNull() | F.col("set_id").isNull()
    rows = sketches.select("doc_id", "text_hash", "set_id")
    joined = rows.where(~alone).join(classes, "set_id").select("doc_id", "text_hash", "class_id", "n_links")
    return joined.union(rows.where(alone).select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(doc_id, class_id, n_links) of each row: the smallest id in its group, and how many rows it links to."""
    return labelled(docs, key, text, words, threshold, recall).drop("text_hash")


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id; rows without an id stay.

    Rows equal in id and text count as one document. If a group's smallest id has several texts in it,
    each of them stays.
    """
    labels = cut(labelled(docs, key, text, words, threshold, recall))
    gone = cut(labels.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = docs.join(gone, (docs[key].cast("long") == gone["_gone"]) & (F.xxhash64(docs[text].cast("string")) == gone["_hash"]), "left_anti")
    again = labels.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if again:
        named, other = kept.where(F.col(key).isNotNull()), kept.where(F.col(key).isNull())
        kept = named.dropDuplicates([key, text]).unionByName(other)
    return kept
