"""Ordered-sequence queries: conversations and events as transcripts, captions and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.functions import maps
from chalkline.operators import evaluation, ordered
from chalkline.registry import query
from chalkline.session import table
from chalkline.streaming import jobs, segmenter


@query(
    "slide_islands",
    """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, event_type FROM events),
i AS (SELECT *, page - row_number() OVER (PARTITION BY user_id, event_type ORDER BY page) AS g FROM p)
SELECT user_id, event_type, min(page) AS first, max(page) AS last, count(*) AS n FROM i GROUP BY user_id, event_type, g""",
)
def slide_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive pages of one title."""
    e = table(spark, sf_dir, "events")
    pages = e.withColumn("page", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    out = ordered.islands(pages, ["user_id"], "page", "event_type")
    return out.groupBy("user_id", "event_type", "island").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


@query(
    "forward_fill",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chapter FROM events""",
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last chapter mark at or before each row."""
    e = table(spark, sf_dir, "events").withColumns({"_mark": F.when(F.col("event_type") == "purchase", F.col("event_id")), "_at": F.struct("ts", "event_id")})
    return ordered.filled(e, ["user_id"], "_at", "_mark", "chapter").select("event_id", "chapter")


_SEQ = "SELECT event_id, user_id, ts, event_type, (event_id * 7919) % 101 + 1 AS seq FROM events"


@query(
    "late_drop",
    f"""SELECT event_id, seq FROM (SELECT *, coalesce(max(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM ({_SEQ})) WHERE seq > seen""",
)
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets whose sequence exceeds all seen before."""
    e = _packets(spark, sf_dir)
    return ordered.monotone(e, ["user_id"], "_at", "seq").select("event_id", "seq")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return e.withColumns({"seq": (F.col("event_id") * 7919) % 101 + 1, "_at": F.struct("ts", "event_id")})


@query(
    "draft_drop",
    f"""WITH e AS (SELECT *, event_type = 'purchase' AS final FROM ({_SEQ})),
p AS (SELECT *, coalesce(sum(final::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM e),
d AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM p WHERE NOT final)
SELECT event_id, seq FROM d WHERE seq > seen""",
)
def draft_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts in monotone order, counted anew after each final."""
    e = _packets(spark, sf_dir).withColumn("final", F.col("event_type") == "purchase")
    return ordered.monotone_until(e, ["user_id"], "_at", "seq", "final").select("event_id", "seq")


@query(
    "context_history",
    """SELECT conv_id, turn, coalesce(string_agg(text, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations WHERE text IS NOT NULL""",
)
def context_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three texts strictly before each turn."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return ordered.history(c, ["conv_id"], "turn", "text").select("conv_id", "turn", F.array_join("history", " / ").alias("history"))


@query(
    "stale_skip",
    """WITH j AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS queued, epoch_us(ts) / 1e6 + value % 9 AS started FROM events),
n AS (SELECT *, lead(queued) OVER (PARTITION BY user_id ORDER BY queued, event_id) AS nxt FROM j)
SELECT event_id, coalesce((started - queued) * 1000 > 3000 AND nxt <= started, false) AS skipped FROM n""",
)
def stale_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that waited over three seconds while a newer one was queued."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    j = table(spark, sf_dir, "events").withColumns({"queued": at, "started": at + F.col("value") % 9})
    j = j.withColumn("_order", F.struct("queued", "event_id"))
    return ordered.stale_skips(j, ["user_id"], "_order", "queued", "started").select("event_id", "skipped")


@query(
    "throttled_drafts",
    """WITH e AS (SELECT *, CAST(floor((epoch_us(ts) / 1e6) / 3600) AS BIGINT) AS slot FROM events)
SELECT user_id, slot, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n = 1""",
)
def throttled_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of each user in each hour."""
    slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 3600)
    e = table(spark, sf_dir, "events").withColumn("slot", slot)
    return ordered.newest(e, ["user_id", "slot"], [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "slot", "event_id")


@query(
    "sequence_numbers",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + user_id % 10 AS sequence,
  format('s{}-r1-seg-{:06d}', user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + user_id % 10) AS segment_id FROM events""",
)
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that go on after the last one used, and segment ids."""
    from chalkline.functions.text import segment_id

    e = table(spark, sf_dir, "events").withColumn("used", F.col("user_id") % 10)
    e = ordered.numbered(e, ["user_id"], ["ts", "event_id"], "used")
    return e.select("event_id", "sequence", segment_id(F.concat(F.lit("s"), F.col("user_id").cast("string")), F.lit("r1"), F.col("sequence")).alias("segment_id"))


@query(
    "speech_confidence",
    """SELECT user_id, round(min(CASE WHEN value > 50 THEN value END), 6) AS low, round(least(1, greatest(0, exp(avg(-value / 100)))), 6) AS pseudo,
  count(*) FILTER (NOT coalesce(value / 100 < 0.5, false)) AS n_kept FROM events GROUP BY user_id""",
)
def speech_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least confidence, pseudo-confidence of log probabilities, results over the guard."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.round(F.min(F.when(F.col("value") > 50, F.col("value"))), 6).alias("low"), F.round(evaluation.mean_confidence(-F.col("value") / 100), 6).alias("pseudo"),
        F.count_if(~F.coalesce(F.col("value") / 100 < 0.5, F.lit(False))).alias("n_kept"),
    )


@query(
    "locale_maps",
    """WITH t AS (SELECT conv_id, turn, text AS ko, CASE WHEN turn % 2 = 0 THEN 'T ' || role END AS en, CASE WHEN turn % 3 = 0 THEN ' ' ELSE role END AS ja FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, coalesce(en, trim(ko)) AS en_text, en IS NULL AS en_fallback, CASE WHEN trim(ja) = '' THEN trim(ko) ELSE trim(ja) END AS ja_text,
  array_to_string(list_concat(CASE WHEN en IS NULL THEN ['en-US'] ELSE [] END, CASE WHEN trim(ja) = '' THEN ['ja-JP'] ELSE [] END), ',') AS missing,
  CASE WHEN en IS NULL THEN '-' ELSE en END AS merged_en FROM t""",
)
def locale_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locale maps with fallbacks, missing locales, and a merge that keeps the first text."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    en = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("T "), "role"))
    ja = F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("role"))
    locales = F.array(F.lit("en-US"), F.lit("ja-JP"))
    got = F.map_from_arrays(locales, F.array(en, ja))
    shown = maps.locale_map(locales, got, F.col("text"))
    merged = maps.first_non_blank(got, F.create_map(F.lit("en-US"), F.lit("-"), F.lit("ja-JP"), F.lit("-")))
    return c.select(
        "conv_id", "turn", shown["en-US"]["text"].alias("en_text"), shown["en-US"]["isFallback"].alias("en_fallback"), shown["ja-JP"]["text"].alias("ja_text"),
        F.array_join(maps.missing_locales(locales, got), ",").alias("missing"), merged["en-US"].alias("merged_en"),
    )


@query("speech_segments")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations segmented as streams of recognised speech, one result every second."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null")
    finals = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "text", F.lit(0.9).alias("confidence"), F.col("turn").cast("double").alias("at"))
    return segmenter.segments(finals)


@query(
    "dedupe_attempts",
    """WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, event_id AS ord, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 THEN 30000000::BIGINT ELSE 3600000000 END AS live FROM events WHERE user_id IS NOT NULL),
l AS (SELECT key, list(struct_pack(us := us, ord := ord, live := live) ORDER BY us, ord) AS a FROM e GROUP BY key),
r AS (SELECT key, a, 1 AS k FROM l UNION ALL SELECT key, a, nxt FROM (SELECT key, a, list_position(list_transform(a, lambda x, i: i > k AND x.us >= a[k].us + a[k].live), true) AS nxt FROM r) WHERE nxt > 0)
SELECT e.key, e.ord, e.us / 1e6 AS at, r.key IS NOT NULL AS acquired FROM e LEFT JOIN r ON r.key = e.key AND r.a[r.k].ord = e.ord""",
)
def dedupe_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that may run: none with a live entry of the same key."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    outcome = F.when(F.col("event_id") % 3 == 0, "failed").otherwise("done")
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return jobs.acquisitions(e.select(key.alias("key"), F.col("event_id").alias("ord"), at.alias("at"), outcome.alias("outcome")))
