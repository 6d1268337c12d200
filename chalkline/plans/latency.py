"""Latency analytics on events: value as milliseconds, event_type as stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators import latency
from chalkline.registry import query
from chalkline.session import table


@query(
    "latency_percentiles",
    """WITH s AS (SELECT DISTINCT event_type FROM events UNION ALL SELECT 'never_measured'),
e AS (SELECT event_type, value FROM events WHERE value IS NOT NULL AND (event_type <> 'click' OR user_id = (SELECT min(user_id) FROM events WHERE event_type = 'click'))),
a AS (SELECT event_type, count(*) AS n, quantile_cont(value::DOUBLE, 0.5) AS p50, quantile_cont(value::DOUBLE, 0.95) AS p95, max(value)::DOUBLE AS mx, avg(value) AS mean FROM e GROUP BY ALL)
SELECT event_type, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'not measured' WHEN n < 5 THEN 'skipped' ELSE 'ok' END AS status,
  CASE WHEN n >= 5 THEN round(p50, 6) END AS p50, CASE WHEN n >= 5 THEN round(p95, 6) END AS p95, CASE WHEN n >= 5 THEN round(mx, 6) END AS max, CASE WHEN n >= 5 THEN round(mean, 6) END AS mean
FROM s LEFT JOIN a USING (event_type)""",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each stage, small samples suppressed, unmeasured stages kept."""
    e = table(spark, sf_dir, "events")
    first = e.where("event_type = 'click'").agg(F.min("user_id").alias("_u"))
    stages = e.select("event_type").distinct().union(spark.createDataFrame([("never_measured",)], "event_type string"))
    samples = e.join(F.broadcast(first)).where("event_type <> 'click' or user_id = _u").select("event_type", "value")
    return latency.percentiles(samples, "event_type", "value", stages)


@query(
    "latency_counts",
    """SELECT event_type, count(*) AS n, count(*) FILTER (coalesce(value < 10, false)) AS n_skipped FROM events GROUP BY ALL""",
)
def latency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("skipped", F.col("value") < 10)
    return latency.counts_by_kind(e, "event_type", "skipped")


@query(
    "latency_derived",
    """WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t1, lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t0, user_id FROM events)
SELECT event_id, round((t1 - t0) * 1000, 1) AS elapsed_ms, CAST(floor(event_id * 12345 / 10000.0) AS BIGINT) AS ticks_ms, 0.5 * pow(2.0, event_id % 4) AS backoff_s FROM e""",
)
def latency_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed time since a user's previous event, ticks and backoff."""
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").withColumn("_at", at)
    e = e.withColumn("_before", F.lag("_at").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select(
        "event_id", latency.elapsed_ms(F.col("_before"), F.col("_at")).alias("elapsed_ms"), latency.ticks_to_ms(F.col("event_id") * 12345).alias("ticks_ms"),
        latency.backoff(0.5, F.col("event_id") % 4 + 1).alias("backoff_s"),
    )


@query(
    "doc_type_stats",
    """SELECT lang AS doc_type, count(*) AS n, round(avg(length(text)), 6) AS mean, min(length(text)) AS shortest, max(length(text)) AS longest,
  sum(greatest(1, length(text) // 2))::BIGINT AS tokens FROM documents GROUP BY lang""",
)
def doc_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and text lengths by document type, and estimated tokens."""
    from chalkline.functions.text import estimate_tokens
    from chalkline.sources.writers import chunk_stats

    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "doc_type")
    return chunk_stats(d, F.sum(estimate_tokens(F.col("text"))).alias("tokens"))
