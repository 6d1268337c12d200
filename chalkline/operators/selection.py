"""Exact order statistics of groups of any size, by counting in ranges.

Each wanted rank of a group has a bracket [lo, hi] of values that holds it. A round counts the group's values in the
bracket by ``BUCKETS`` ranges (partial counts in the tasks, so at most that many rows a bracket are shuffled), takes
the range in which the rank lies, and sets the bracket to the least and the largest value found there. It ends when
these are equal. Ranges are equal in the values and in their logarithms by turns, so neither outliers nor values over
many scales make it slow. No task holds a group's values.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.session import cut

BUCKETS = 4096
#: Groups of at most so many values are sorted in one task each; larger ones are counted in ranges.
SORTED_VALUES = 200_000


def _positions(quantiles: tuple[float, ...]) -> Column:
    """The ranks below and above each quantile's place among n values."""
    place = [(F.col("n") - 1) * q for q in quantiles]
    return F.array_distinct(F.array(*[x.cast("long") for p in place for x in (F.floor(p), F.ceil(p))]))


def _scale(v: Column, logarithms: bool) -> Column:
    """A place that ascends with the value: the value (halved, so that no difference overflows) or its order of magnitude."""
    if not logarithms:
        return v / 2
    size = F.lit(1100.0) + F.log2(F.abs(v))
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0.0)


def _refined(values: DataFrame, group: str, brackets: DataFrame, logarithms: bool) -> DataFrame:
    """``brackets`` (group, rank, lo, hi, below) after one round."""
    ranges = brackets.select(group, "lo", "hi").distinct().withColumnsRenamed({group: "_group"})
    inside = values.join(ranges, (F.col(group) == F.col("_group")) & F.col("v").between(F.col("lo"), F.col("hi")))
    at, low, high = (_scale(F.col(c), logarithms) for c in ("v", "lo", "hi"))
    bucket = F.when(high > low, F.least(F.lit(BUCKETS - 1), F.floor((at - low) / (high - low) * BUCKETS))).otherwise(0)
    counts = inside.groupBy(group, "lo", "hi", bucket.alias("bucket")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    open_ = brackets.join(counts, [group, "lo", "hi"])
    before = F.col("below") + F.sum("c").over(Window.partitionBy(group, "rank").orderBy("bucket")) - F.col("c")
    found = open_.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
    return found.select(group, "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("before").alias("below"))


def ranked_values(values: DataFrame, group: str, sizes: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """(group, rank, value) of the ranks that ``quantiles`` need; ``sizes`` (group, n, lo, hi) of ``values`` (group, v)."""
    brackets = sizes.select(group, F.explode(_positions(quantiles)).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    done, brackets = None, cut(brackets)
    for round_ in count():
        ready = brackets.where("lo = hi").select(group, "rank", F.col("lo").alias("value"))
        done = ready if done is None else done.unionByName(ready)
        brackets = brackets.where("lo < hi")
        if brackets.isEmpty():
            return done
        brackets = cut(_refined(values, group, brackets, round_ % 2 == 1))


def quantiles(rows: DataFrame, group: str, value: str, wanted: tuple[float, ...]) -> DataFrame:
    """(group, q array) with linear interpolation; null and not finite values are no samples, groups without any go."""
    v = F.col(value).cast("double")
    values = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.col(group), v.alias("v"))
    sizes = cut(values.groupBy(group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    small = sizes.where(F.col("n") <= SORTED_VALUES)
    out = values.join(small.select(group), group, "left_semi").groupBy(group).agg(F.percentile("v", F.array(*[F.lit(q) for q in wanted])).alias("q"))
    large = sizes.where(F.col("n") > SORTED_VALUES)
    if large.isEmpty():
        return out
    found = ranked_values(values, group, large, wanted).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    found = found.join(large.select(group, "n"), group)

    def between(q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(q))
        low, high = (F.element_at("at", x.cast("long")) for x in (F.floor(place), F.ceil(place)))
        part = place - F.floor(place)
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return out.unionByName(found.select(group, F.array(*[between(q) for q in wanted]).alias("q")))
