"""Control-plane relations on the star tables: customers as courses, orders as sessions, line items as attendance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.operators import ordered, relational
from chalkline.registry import query
from chalkline.session import table


@query(
    "sessions_with_course",
    """SELECT o_orderkey, coalesce(c_name, '') AS course_name, o_orderstatus FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 12""",
)
def sessions_with_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their course's name, '' where there is none."""
    c = table(spark, sf_dir, "customer").where("c_nationkey < 12").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("course_name"), "o_orderstatus")


@query(
    "course_materials",
    """SELECT c_custkey, count(*) AS n_materials, count(DISTINCT o_orderpriority) AS n_kinds FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 GROUP BY c_custkey""",
)
def course_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials of the courses that a viewer owns."""
    c = relational.visible_courses(table(spark, sf_dir, "customer"), "c_nationkey", "professor", 7)
    o = relational.optional_filters(table(spark, sf_dir, "orders"), o_orderstatus=None)
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_materials"), F.count_distinct("o_orderpriority").alias("n_kinds"))


@query(
    "my_sessions",
    """SELECT l_orderkey, l_linenumber, o_orderstatus, c_nationkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_totalprice > 100000
LEFT JOIN customer ON o_custkey = c_custkey WHERE l_suppkey = 3 AND o_orderkey IS NOT NULL""",
)
def my_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attendance with session and course; without a session it goes."""
    mine = table(spark, sf_dir, "lineitem").where("l_suppkey = 3").select("l_orderkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    out = mine.join(o, mine.l_orderkey == o.o_orderkey, "left").where("o_orderkey is not null").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_nationkey")


@query(
    "eager_user",
    """SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def eager_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query(
    "attended_courses",
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
)
def attended_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: courses with a finished session."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("fresh_chunks", """SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def fresh_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join: chunks that are not indexed yet."""
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(known, "p_partkey", "left_anti").select("p_partkey")


@query(
    "student_materials",
    """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_custkey = 7 OR o_custkey % 10 = 0)""",
)
def student_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lecture material of the viewer's session or of no session; unknown states show as null."""
    session = F.when(F.col("o_custkey") % 10 == 0, None).otherwise(F.col("o_custkey"))
    m = table(spark, sf_dir, "orders").withColumn("session", session)
    seen = relational.visible_materials(m, "o_orderpriority", "session", 7, "1-URGENT")
    return seen.select("o_orderkey", "o_orderpriority", relational.whitelisted(F.col("o_orderstatus"), ("F", "O")).alias("status"))


@query(
    "transcript_page",
    """SELECT conv_id, turn, role FROM conversations WHERE conv_id > 2 OR (conv_id = 2 AND turn > 0) ORDER BY conv_id, turn LIMIT 200""",
)
def transcript_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyset page after a row, 200 rows unless asked otherwise."""
    return relational.page(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], (2, 0))


@query(
    "transcript_upsert",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def transcript_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each key wins, over an older snapshot."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    old = relational.last_wins(e.where("event_id % 2 = 0"), ["user_id", "event_type"], ["ts", "event_id"])
    all_seen = old.unionByName(e.where("event_id % 2 = 1"))
    return relational.last_wins(all_seen, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(
    "keyed_update",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'failed' WHEN lower(p_name) LIKE '%a%' THEN 'ready' ELSE 'none' END AS status, p_partkey % 6 = 0 AS affected FROM part WHERE p_partkey % 11 <> 0""",
)
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill by pattern, update by key with affected rows, delete by key."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.lower("p_name").like("%a%"), "ready").otherwise("none").alias("status"))
    changes = p.where("p_partkey % 6 = 0").select("p_partkey", F.lit("failed").alias("status"))
    out = relational.updated(p, changes, "p_partkey", ["status"])
    return relational.deleted(out, p.where("p_partkey % 11 = 0"), "p_partkey")


@query(
    "active_sessions",
    """SELECT o_custkey, count(*) AS n, CASE WHEN count(*) = 1 THEN 'one' ELSE 'many' END AS state FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey""",
)
def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("state", F.when(F.col("n") == 1, "one").otherwise("many"))


@query(
    "default_material",
    """SELECT o_custkey, arg_max(o_orderkey, {'r': CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, 'd': o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey""",
)
def default_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ready material, else the latest."""
    ready = F.struct((F.col("o_orderstatus") == "F").cast("int"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", ready).alias("o_orderkey"))


@query(
    "engine_pivot",
    """SELECT l_shipmode_x AS sample, max(CASE WHEN l_returnflag = 'A' THEN v END) AS "A", max(CASE WHEN l_returnflag = 'N' THEN v END) AS "N", max(CASE WHEN l_returnflag = 'R' THEN v END) AS "R"
FROM (SELECT l_suppkey % 7 AS l_shipmode_x, l_returnflag, round(avg(CAST(l_discount AS DOUBLE)), 6) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL""",
)
def engine_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sample with a column for each engine."""
    li = table(spark, sf_dir, "lineitem").withColumn("sample", F.col("l_suppkey") % 7)
    return li.groupBy("sample").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg(F.col("l_discount").cast("double")), 6))


@query(
    "set_operations",
    """SELECT kind, n FROM (
  SELECT 'union' AS kind, count(*) AS n FROM (SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'union_all', count(*) FROM (SELECT n_nationkey FROM nation UNION ALL SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'distinct', count(DISTINCT c_nationkey) FROM customer)""",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    parts = {"union": n.union(s).distinct(), "intersect": c.intersect(s), "except": n.subtract(s), "union_all": n.union(s), "distinct": c.distinct()}
    out = None
    for kind, df in parts.items():
        one = df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", "n")
        out = one if out is None else out.union(one)
    return out


@query(
    "recent_history",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5""",
)
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest of each user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return ordered.newest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query(
    "retained_captions",
    """WITH e AS (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id) AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, event_id FROM e WHERE n <= 30 AND (ts > now - INTERVAL 86400 SECOND OR n = 1)""",
)
def retained_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 captions, those of the last day, one at least."""
    e = table(spark, sf_dir, "events").withColumn("now", F.max("ts").over(Window.partitionBy("user_id")))
    return ordered.retained(e, ["user_id"], "event_id", "ts", "now", 30, 86400).select("user_id", "event_id")
