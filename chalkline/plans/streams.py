"""Queries of the stream operators over events and conversations, and of the stores and channels they use."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.registry import query
from chalkline.session import ensure_checkpoint_dir, table
from chalkline.sources import channel
from chalkline.sources.snapshots import VersionedIndex
from chalkline.streaming import conflate, joins, lanes, numbering, ordering, pairs
from chalkline.streaming.jobs import valid_events
from chalkline.streaming.upserts import Upserts

_HOUR = 3_600_000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _at(ts: str = "ts") -> Column:
    return F.col(ts).cast("timestamp")


@query(
    "ordered_emission",
    f"""WITH p AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms + (event_id * 7919) % 101 * {_HOUR}, event_id) AS ord FROM p),
m AS (SELECT *, max(ms) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {48 * _HOUR} AS mark FROM a),
l AS (SELECT *, EXISTS (SELECT 1 FROM m q WHERE q.user_id = m.user_id AND q.ord < m.ord AND q.seq > m.seq AND q.ms <= m.mark) AS late FROM m)
SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY user_id, late ORDER BY seq) END AS place, seq AS sequence, event_type AS text, late FROM l""",
)
def ordered_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that come up to 100 hours late, in order by number under a watermark of 48 hours."""
    users = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("sequence", F.row_number().over(users.orderBy("ts", "event_id")))
    arrival = F.unix_millis(_at()) + F.col("event_id") * 7919 % 101 * _HOUR
    e = e.withColumn("ord", F.row_number().over(users.orderBy(arrival, "event_id")))
    return ordering.in_order(e.select(F.col("user_id").alias("session_id"), "ord", "sequence", F.col("event_type").alias("text"), _at().alias("at")), 48 * _HOUR)


@query(
    "json_pairs",
    """WITH c AS (SELECT conv_id || '/' || turn AS item_id, role, text, turn, '{"role":' || to_json(role) AS r FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL),
t AS (SELECT *, r || ',"text":' || to_json(text) AS x FROM c), n AS (SELECT *, x || ',"turn":' || turn AS y FROM t), m AS (SELECT *, y || ',"more":["' || role || '",{"k":' || turn || '}]' AS z FROM n)
SELECT item_id, (length(r) - 1) // 7 AS ord, 'role' AS name, role AS value FROM m UNION ALL SELECT item_id, (length(x) - 1) // 7, 'text', text FROM m
UNION ALL SELECT item_id, length(y) // 7, 'turn', CAST(turn AS VARCHAR) FROM m UNION ALL SELECT item_id, (length(z) - 1) // 7, 'more', '["' || role || '",{"k":' || turn || '}]' FROM m""",
)
def json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each turn's JSON text that comes seven characters at a time, with the delta that closes them."""
    c = table(spark, sf_dir, "conversations").where("role is not null and text is not null")
    more = F.concat(F.lit('["'), "role", F.lit('",{"k":'), F.col("turn").cast("string"), F.lit("}]}"))
    head = F.to_json(F.struct("role", "text", "turn"))
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"more":'), more)
    texts = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), whole.alias("whole"))
    cut = texts.select("item_id", "whole", F.explode(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / 7).cast("int"))).alias("ord"))
    return pairs.pairs(cut.select("item_id", "ord", F.substring("whole", F.col("ord") * 7 + 1, F.lit(7)).alias("delta")))


@query(
    "conflated_drafts",
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS final, 'v' || (event_id % 4) AS text, event_id * 7919 % 20 * {_HOUR} AS takes,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS ord FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, coalesce(sum(final::INT) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM e),
l AS (SELECT user_id, epoch, list(struct_pack(ms := ms, text := text, takes := takes) ORDER BY ord) FILTER (WHERE NOT final) AS ps, coalesce(max(ms) FILTER (WHERE final), 9000000000000000) AS stop FROM p GROUP BY ALL),
r AS (SELECT user_id, epoch, 1 AS k, ps, stop, ps[1].ms AS began, ps[1].text AS asked, ps[1].ms + ps[1].takes AS ends FROM l WHERE len(ps) > 0
  UNION ALL SELECT user_id, epoch, k + 1, ps, stop, greatest(b, nxt.ms), nxt.text, greatest(b, nxt.ms) + nxt.takes
  FROM (SELECT *, CASE WHEN ps[j].text <> asked THEN ps[j] ELSE list_filter(ps[j + 1:], lambda x: x.text <> asked)[1] END AS nxt
        FROM (SELECT *, greatest(began + {6 * _HOUR}, ends) AS b, len(list_filter(ps, lambda x: x.ms < greatest(began + {6 * _HOUR}, ends))) AS j FROM r)) WHERE nxt IS NOT NULL AND greatest(b, nxt.ms) <= stop)
SELECT CAST(user_id AS VARCHAR) AS session_id, number, asked AS text, began AS started_ms, ends AS shown_ms
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch, k) AS number FROM r) WHERE ends <= stop""",
)
def conflated_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts shown of each user's partials: one request in flight, six hours between starts, purchases as finals."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "purchase", "final").otherwise("partial").alias("kind"),
        F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")).alias("text"), _at().alias("at"), (F.col("event_id") * 7919 % 20 * _HOUR).alias("takes_ms"),
    )
    return conflate.conflated(rows, conflate.Throttle(interval_ms=6 * _HOUR, min_chars=2))


@query(
    "lane_jobs",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_id * 7919 % 60 * {_HOUR} AS takes, unnest(CASE WHEN event_type = 'view' THEN ['en-US', 'ja-JP'] ELSE ['en-US', 'xx-XX'] END) AS locale
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, row_number() OVER w AS k, lead(ms) OVER w AS nxt FROM e WHERE locale <> 'xx-XX' WINDOW w AS (PARTITION BY user_id, locale ORDER BY ms, event_id)),
r AS (SELECT user_id, locale, k, event_id, ms, ms AS began, false AS stale, ms + takes AS free FROM n WHERE k = 1
  UNION ALL SELECT user_id, locale, k, event_id, ms, began, stale, CASE WHEN stale THEN began ELSE began + takes END FROM (SELECT *, began - ms > {72 * _HOUR} AND coalesce(nxt <= began, false) AS stale
    FROM (SELECT n.*, greatest(r.free, n.ms) AS began FROM r JOIN n ON n.user_id = r.user_id AND n.locale = r.locale AND n.k = r.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS session_id, locale, event_id AS ord, CASE WHEN stale THEN 'skipped' ELSE 'played' END AS status, ms AS queued_ms, CASE WHEN NOT stale THEN began END AS started_ms, CASE WHEN NOT stale THEN free END AS ended_ms FROM r
UNION ALL SELECT CAST(user_id AS VARCHAR), locale, event_id, 'unsupported', ms, NULL, NULL FROM e WHERE locale = 'xx-XX'""",
)
def lane_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs of up to 59 hours for one or two locales, one after the other; those that wait over 72 hours give way to newer ones."""
    e = table(spark, sf_dir, "events")
    locales = F.array(F.lit("en-US"), F.when(F.col("event_type") == "view", "ja-JP").otherwise("xx-XX"))
    jobs = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.lit("job").alias("kind"), locales.alias("locales"), _at().alias("at"), (F.col("event_id") * 7919 % 60 * _HOUR).alias("takes_ms"))
    return lanes.worked_off(jobs, lanes.Lanes(("en-US", "ja-JP"), most_wait_ms=72 * _HOUR))


@query(
    "captions_with_audio",
    f"""WITH c AS (SELECT event_id, user_id, event_id % 3 AS locale, ts FROM events WHERE event_type = 'view'), a AS (SELECT user_id, event_id % 3 AS locale, ts, event_id AS sound FROM events WHERE event_type = 'click')
SELECT c.event_id, a.sound AS sound_ms, epoch_us(a.ts) // 1000 - epoch_us(c.ts) // 1000 AS audio_after_ms FROM c LEFT JOIN a ON c.user_id = a.user_id AND c.locale = a.locale AND a.ts BETWEEN c.ts AND c.ts + INTERVAL 48 HOUR""",
)
def captions_with_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as captions with the clicks of their user and locale within two days, or alone."""
    e = table(spark, sf_dir, "events").withColumns({"locale": F.col("event_id") % 3, "segment_id": F.col("user_id"), "at": _at()})
    captions = e.where("event_type = 'view'").select("event_id", "segment_id", "locale", "at")
    audio = e.where("event_type = 'click'").select("segment_id", "locale", F.col("at").alias("published_at"), F.col("event_id").alias("sound_ms"))
    return joins.captions_with_audio(captions, audio, "48 hours").select("event_id", "sound_ms", "audio_after_ms")


@query(
    "resumed_numbers",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY late, event_id) AS sequence, late FROM (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM events) WHERE user_id IS NOT NULL""",
)
def resumed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream in two runs: the second query takes the last numbers that the first one left as state."""
    path, out, start = f"{sf_dir}/events.parquet*", _folder(spark, "numbers"), None
    schema = table(spark, sf_dir, "events").schema
    for run, of_run in (("r1", "ts < timestamp_ntz '2024-01-16'"), ("r2", "ts >= timestamp_ntz '2024-01-16'")):
        segments = spark.readStream.schema(schema).parquet(path).where(of_run).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"))
        numbered = numbering.numbered_stream(segments, run, start, ttl_hours=None)
        q = numbered.writeStream.format("parquet").option("checkpointLocation", f"{out}/check-{run}").trigger(availableNow=True).start(f"{out}/{run}")
        q.awaitTermination()
        start = numbering.last_numbers(spark, f"{out}/check-{run}")
    made = [spark.read.schema(numbering.NUMBERED).parquet(f"{out}/{run}").withColumn("late", F.lit(run == "r2")) for run in ("r1", "r2")]
    return reduce(DataFrame.unionByName, made).select(F.col("ord").alias("event_id"), "session_id", "sequence", "late")


@query(
    "versioned_index",
    """WITH v AS (SELECT vec_id, label, 1 AS version FROM embeddings UNION ALL SELECT vec_id, label, 2 FROM embeddings WHERE label % 2 = 1 OR vec_id % 3 = 0 UNION ALL SELECT vec_id, label, 3 FROM embeddings)
SELECT version, label, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL GROUP BY ALL""",
)
def versioned_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label: all, then even labels replaced by a third of their rows, then what is missing added; each version read."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null and label is not null").select("vec_id", "embedding", "label")
    index = VersionedIndex(spark, _folder(spark, "index"), "label", rows.schema)
    versions = [index.replace(rows), index.replace(rows.where("label % 2 = 0 and vec_id % 3 = 0")), index.append_new(rows, ["vec_id"])]
    read = [index.read(v).groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids")).withColumn("version", F.lit(v)) for v in versions]
    return reduce(DataFrame.unionByName, read)


@query(
    "compacted_upserts",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 7 DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def compacted_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type after seven batches, the third sent twice, with runs merged by threes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    held = Upserts(spark, _folder(spark, "upserts"), rows.schema, ["user_id", "event_type"], ["ts", "event_id"], fan=3, buckets=4)
    for k in (0, 1, 2, 2, 3, 4, 5, 6):
        held.merge(rows.where(F.col("event_id") % 7 == k), k)
    return held.read().drop("ts")


@query(
    "indexed_materials",
    """WITH m AS (SELECT event_id // 20 AS id, event_type, event_id, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error')
SELECT page_id, url, coalesce(event_type, 'pending') AS status, coalesce(event_id, -1) AS event_id FROM pages LEFT JOIN m ON id = page_id AND n = 1 WHERE page_id IS NOT NULL""",
)
def indexed_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as materials whose status follows a stream of messages; broken ones and those of unknown materials change nothing."""
    event, folder = F.col("event_id"), _folder(spark, "materials")
    pages = table(spark, sf_dir, "pages").where("page_id is not null").select("page_id", "url", F.lit("pending").alias("status"), F.lit(-1).cast("long").alias("event_id"))
    held = Upserts(spark, f"{folder}/table", pages.schema, ["page_id"], ["event_id"])
    held.merge(pages, 0)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").where("event_type is not null")
    whole = F.to_json(F.struct(F.floor(event / 20).alias("page_id"), F.col("event_type").alias("status"), "event_id"))
    raw = stream.select(F.when(F.col("event_type") == "error", F.left(whole, F.length(whole) - 1)).otherwise(whole).alias("value"))
    changes = valid_events(raw, "page_id bigint, status string, event_id bigint", ["page_id", "status"])
    held.start(changes, f"{folder}/check", only_known=True, first=1).awaitTermination()
    return held.read()


@query(
    "channel_messages",
    """SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND user_id IS NOT NULL""",
)
def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published to a channel by topic, two topics read back, messages without a user dropped."""
    kind, path = channel.register(spark), _folder(spark, "channel")
    e = table(spark, sf_dir, "events")
    message = e.select(F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    message.write.format(kind).option("path", path).mode("append").save()
    read = [spark.read.format(kind).option("path", path).option("topic", t).load().select("value") for t in ("view", "click")]
    return valid_events(reduce(DataFrame.unionByName, read), "event_id bigint, user_id bigint, event_type string", ["event_id", "user_id"])
