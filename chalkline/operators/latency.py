"""Latency analytics: exact percentiles, suppression of small samples, counts by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.operators.selection import quantiles

MIN_SAMPLES = 5


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times in seconds, one decimal; null if either is."""
    return F.round((end - start) * 1000, 1)


def ticks_to_ms(ticks: Column) -> Column:
    """Whole milliseconds of 100-nanosecond ticks."""
    return F.floor(ticks.cast("long") / 10_000)


def backoff(base: float, attempt: Column) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)


def percentiles(samples: DataFrame, stage: str, value: str, stages: DataFrame | None = None, least: int = MIN_SAMPLES) -> DataFrame:
    """n, p50, p95, max and mean of each stage by linear interpolation.

    Stages listed in ``stages`` but never measured stay, as "not measured"; stages with fewer than
    ``least`` samples are "skipped" and show their count only. A null stage is one of its own if it is listed.
    """
    measured = samples.where(F.col(value).isNotNull())
    stats = measured.groupBy(stage).agg(F.count("*").alias("n"), F.max(F.col(value).cast("double")).alias("_max"), F.avg(value).alias("_mean"))
    stats = stats.join(quantiles(measured, stage, value, (0.5, 0.95)), stage, "left")
    if stages is not None:
        listed = stages.select(F.col(stage).alias("_stage")).distinct()
        stats = stats.join(listed, stats[stage].eqNullSafe(F.col("_stage")), "full").withColumn(stage, F.coalesce(stage, "_stage")).drop("_stage")
    n = F.coalesce("n", F.lit(0).cast("long"))
    shown = lambda c: F.when(n >= least, F.round(c, 6))
    status = F.when(n == 0, "not measured").when(n < least, "skipped").otherwise("ok")
    return stats.select(
        stage, n.alias("n"), status.alias("status"), shown(F.col("q")[0]).alias("p50"), shown(F.col("q")[1]).alias("p95"), shown(F.col("_max")).alias("max"), shown(F.col("_mean")).alias("mean")
    )


def speech_end(anchor: Column, offset_ms: Column, duration_ms: Column) -> Column:
    """Time in seconds at which speech ended: when the sound began, plus its place and length in it; null if any is."""
    return anchor + (offset_ms + duration_ms) / 1000


def counts_by_kind(records: DataFrame, kind: str, skipped: str) -> DataFrame:
    """Records and skipped ones of each kind."""
    return records.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(skipped), F.lit(False))).alias("n_skipped"))
