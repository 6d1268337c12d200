"""Mixing sources to target weights: rates of repetition by source, whole copies and one seeded draw a document.

Sizes are summed by source. Sources are numbered in code-point order, null last; their numbers give their weights.
The mix is to hold ``share`` of all sizes, dealt by weight; a source's target stops at ``most`` times its size, and
what is over is dealt again among the others until none is above. A document is taken floor(rate) times and once
more if a hash of seed and key, read as a number in [0, 1), is below the rest of the rate, where rate is target by
size of its source. So reruns and recomputed tasks agree, and no document is taken more than ``most`` times.

The driver gets three sums a round of dealing, never the sources. Sources are numbered by ranges of their names, no
task holds them all. Texts are not shuffled: they are read twice, for the sums and for the copies.

Defined results: a null or empty text has size 0; null sources are one source; a source of size 0 has target 0 and
its documents are not taken; rows that repeat a key get the same draw; null keys count as empty ones; an empty table
gives no rows; other columns pass through (those named like a result are replaced).
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.session import cut

WEIGHTS = (5, 2, 1)
#: At most so many sources are broadcast; more meet their documents by a shuffle, whose hot keys are split.
BROADCAST_SOURCES = 50_000
#: Hexadecimal digits of a draw: 52 bits, which a double holds.
_DIGITS = 13
_OWN = ("size", "source_size", "target", "copies")


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(key: str, seed: str) -> Column:
    """A number in [0, 1) that depends on seed and key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number`` from 0 in code-point order of ``_source``, null last."""
    order = [F.col("_source").isNull(), F.col("_source")]
    ranged = sources.repartitionByRange(sources.sparkSession.sparkContext.defaultParallelism, *order)
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    counts = sorted(ranged.groupBy("_part").count().collect())
    before = [0, *accumulate(n for _, n in counts)]
    start = F.create_map(*[F.lit(x) for (part, _), first in zip(counts, before) for x in (part, first)]) if counts else F.create_map(F.lit(0), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("number", start[F.col("_part")] + inside).drop("_part")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``_source``, source_size and target of each source of ``sizes`` (_source, size); the mix holds share[0] / share[1] of all."""
    up, down = share
    sources = _numbered(sizes.groupBy("_source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("weight", weight.cast("long")))
    over, level = F.lit(False), (0, 1)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    n_over = -1
    while True:
        x = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not x.weight or x.n == n_over:
            break
        n_over, level = x.n, (up * total - down * most * (x.full or 0), down * x.weight)
        exact = lambda c: c.cast("decimal(19,0)")
        over = exact(F.col("weight")) * F.lit(level[0]).cast("decimal(19,0)") > exact(F.col("source_size") * most) * F.lit(level[1]).cast("decimal(19,0)")
    shared = (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1]))
    return sources.select("_source", "source_size", F.when(over, (F.col("source_size") * most).cast("double")).otherwise(shared).alias("target"))


def with_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix/1", **targets) -> DataFrame:
    """``docs`` with size, source_size and target of the source, and copies: how often the mix takes the document."""
    sized = docs.withColumn("size", word_count(text))
    found = source_targets(sized.select(F.col(f"`{source}`").cast("string").alias("_source"), "size"), **targets)
    found = cut(found)
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    rate = F.when(found["source_size"] > 0, found["target"] / found["source_size"]).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(key, seed) < rate - F.floor(rate)).cast("long")
    kept = [sized[f"`{c}`"] for c in docs.columns if c not in _OWN]
    joined = sized.join(found, sized[f"`{source}`"].cast("string").eqNullSafe(found["_source"]))
    return joined.select(*kept, sized["size"], found["source_size"], found["target"], copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, numbered by ``copy`` from 1."""
    taken = with_copies(docs, **how).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[c for c in docs.columns if c != "copy"], "copy")
