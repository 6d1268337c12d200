"""Vector retrieval and its evaluation on embeddings: labels as indexes, every hundredth vector as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators import evaluation, retrieval
from chalkline.registry import query
from chalkline.session import table

_HITS = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS e
      FROM (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, round(list_inner_product(q.e, c.e), 9) AS score
      FROM u q, u c WHERE q.vec_id % 100 = 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, chunk_id) AS n FROM s) WHERE n <= 5),
m AS (SELECT query_id, chunk_id, max(score) AS score, arg_max(CAST(label AS VARCHAR), score) AS index_name FROM k GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m)
"""
_RANKS = (
    _HITS
    + """, asked AS (SELECT vec_id AS query_id, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS query_type, label FROM embeddings WHERE vec_id % 100 = 0),
answers AS (SELECT query_id, c.vec_id AS chunk_id FROM asked JOIN embeddings c ON asked.label = c.label WHERE c.vec_id % 7 = 0 AND asked.label <> 9),
ranks AS (SELECT query_id, query_type,
            (SELECT count(*) FROM answers a WHERE a.query_id = asked.query_id) AS n_answers,
            (SELECT min(rank) FROM hits h JOIN answers a USING (query_id, chunk_id) WHERE h.query_id = asked.query_id) AS first_rank,
            (SELECT count(*) FROM hits h JOIN answers a USING (query_id, chunk_id) WHERE h.query_id = asked.query_id) AS n_found,
            (SELECT max(score) FROM hits h WHERE h.query_id = asked.query_id) AS top_score
          FROM asked)
"""
)


def _hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    vectors = v.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("index_name"), "embedding")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k_per_index(vectors, queries, k)


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    answers = v.where("vec_id % 7 = 0 and label <> 9").select(F.col("label").alias("group"), F.col("vec_id").alias("chunk_id"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("query_type"), F.col("label").alias("group"))
    return evaluation.group_answer_ranks(asked, answers, retrieval.merged_hits(_hits(spark, sf_dir)))


@query("retrieve_topk", _HITS + "SELECT query_id, chunk_id, index_name, round(score, 6) AS score, rank, (max(score) OVER (PARTITION BY query_id)) >= 0.45 AS use_rag FROM hits WHERE rank <= 5")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best hits of each query over all indexes, and the score gate."""
    hits = retrieval.merged_hits(_hits(spark, sf_dir), 5)
    tops = hits.where("rank = 1").select("query_id", F.col("score").alias("_top"))
    gate = retrieval.gated(F.lit(True), F.col("_top"), 0.45)
    return hits.join(tops, "query_id").select("query_id", "chunk_id", "index_name", F.round("score", 6).alias("score"), "rank", gate.alias("use_rag"))


@query(
    "retrieve_routed",
    _HITS
    + """, g AS (SELECT query_id, CASE WHEN label < 4 THEN 'ai' WHEN label < 7 THEN 'hss' ELSE 'bme' END AS major,
                  CASE WHEN label < 4 THEN 0 WHEN label < 7 THEN 1 ELSE 2 END AS o, chunk_id, score FROM k),
t AS (SELECT query_id, major, o, max(score) AS top, max(score) >= CASE major WHEN 'ai' THEN 0.5 ELSE 0.45 END AS ok FROM g GROUP BY query_id, major, o),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, top DESC, o) AS n FROM t) WHERE n = 1),
b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n
      FROM (SELECT g.query_id, chunk_id, max(score) AS score FROM g JOIN w ON g.query_id = w.query_id AND g.major = w.major AND ok GROUP BY ALL))
SELECT w.query_id, w.major, round(top, 6) AS top_score, ok AS use_rag, CASE WHEN ok THEN 'ROUTED' ELSE 'SCORE_BELOW_THRESHOLD' END AS reason,
  coalesce(chunks, '') AS chunks
FROM w LEFT JOIN (SELECT query_id, string_agg(chunk_id, ',' ORDER BY n) AS chunks FROM b WHERE n <= 3 GROUP BY query_id) c ON c.query_id = w.query_id""",
)
def retrieve_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning major of each query with its gate and three chunks."""
    label = F.col("index_name").cast("int")
    order = F.when(label < 4, 0).when(label < 7, 1).otherwise(2)
    hits = _hits(spark, sf_dir).withColumns({"major_order": order, "major": F.element_at(F.array(F.lit("ai"), F.lit("hss"), F.lit("bme")), order + 1)})
    thresholds = spark.createDataFrame([("ai", 0.5), ("hss", 0.45), ("bme", 0.45)], "major string, threshold double")
    return retrieval.retrieve(hits, thresholds, 3).withColumn("top_score", F.round("top_score", 6))


@query(
    "eval_metrics",
    _RANKS
    + """SELECT coalesce(query_type, 'ALL') AS "group", count(*) AS n,
  round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3,
  round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr,
  round(avg(CASE WHEN n_found = n_answers THEN 1.0 ELSE 0.0 END), 6) AS full_recall
FROM ranks WHERE n_answers > 0 GROUP BY GROUPING SETS ((query_type), ()) HAVING count(*) > 0""",
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metrics(_ranks(spark, sf_dir))


@query(
    "threshold_sweep",
    _RANKS
    + """SELECT threshold, round(avg(CASE WHEN n_answers = 0 THEN CASE WHEN top_score < threshold THEN 1.0 ELSE 0.0 END END), 6) AS blocked,
  round(avg(CASE WHEN n_answers > 0 THEN CASE WHEN top_score >= threshold THEN 1.0 ELSE 0.0 END END), 6) AS passed
FROM ranks, (SELECT round(0.30 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(0, 9) r(i)) GROUP BY threshold""",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_sweep(_ranks(spark, sf_dir))


@query(
    "score_split",
    _RANKS
    + """SELECT CASE WHEN n_answers > 0 THEN 'positive' ELSE 'negative' END AS kind, count(*) AS n, round(avg(top_score), 6) AS mean,
  round(stddev_pop(top_score), 6) AS deviation FROM ranks GROUP BY ALL""",
)
def score_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.score_split(_ranks(spark, sf_dir))


_CHAPTERS = "CASE WHEN lang = 'en' THEN NULL ELSE CAST(n_chars % 5 AS VARCHAR) END"


@query(
    "relaxed_answers",
    f"""WITH c AS (SELECT doc_id AS chunk_id, source, {_CHAPTERS} AS chapter FROM documents),
a AS (SELECT item_id AS query_id, unnest([item_id, item_id + 3]) AS chunk_id FROM benchmark),
r AS (SELECT DISTINCT query_id, coalesce(s.chunk_id, a.chunk_id) AS chunk_id FROM a LEFT JOIN c ON a.chunk_id = c.chunk_id
      LEFT JOIN c s ON s.source = c.source AND s.chapter = c.chapter)
SELECT query_id, count(*) AS n_answers, min(chunk_id) AS first_answer FROM r GROUP BY query_id""",
)
def relaxed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers widened to the chapter's chunks."""
    chapter = F.when(F.col("lang") == "en", None).otherwise((F.col("n_chars") % 5).cast("string"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", chapter.alias("chapter"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.col("item_id"), F.col("item_id") + 3).alias("answers"))
    wide = evaluation.relaxed_answers(queries, chunks)
    return wide.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_answers"), F.min("chunk_id").alias("first_answer"))


@query(
    "label_adjustment",
    """WITH m AS (SELECT label, list(vec_id) AS members FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY label),
a AS (SELECT label, list(vec_id) AS answers FROM embeddings WHERE vec_id % 20 < 4 GROUP BY label)
SELECT a.label, len(list_intersect(answers, members)) AS n_kept, len(list_filter(answers, lambda x: NOT list_contains(members, x))) AS n_lost,
  len(list_intersect(answers, members)) = 0 AS dropped FROM a JOIN m USING (label)""",
)
def label_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that each index keeps and loses."""
    v = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    members = v.where("vec_id % 3 <> 0").select("label", "vec_id", F.lit(True).alias("_in")).distinct()
    answers = v.where("vec_id % 20 < 4").select("label", "vec_id").distinct()
    kept = F.count("_in")
    out = answers.join(members, ["label", "vec_id"], "left").groupBy("label").agg(kept.alias("n_kept"), (F.count(F.lit(1)) - kept).alias("n_lost"), (kept == 0).alias("dropped"))
    return out.join(members.select("label").distinct(), "label", "left_semi")


@query(
    "best_model",
    """WITH m AS (SELECT source, lang, round(avg(n_chars), 6) AS r1, CAST(max(n_chars) AS DOUBLE) AS mrr FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS n, lead(r1) OVER w AS nxt, lead(lang) OVER w AS runner_up FROM m WINDOW w AS (PARTITION BY source ORDER BY r1 DESC, mrr DESC, lang))
SELECT source, lang, r1, runner_up, round(r1 - nxt, 6) AS lead FROM r WHERE n = 1""",
)
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several models by two measures, and its lead."""
    m = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 6).alias("r1"), F.max("n_chars").cast("double").alias("mrr"))
    return evaluation.best_model(m, "source", "lang", "r1", "mrr")


@query(
    "context_budget",
    """WITH b AS (SELECT conv_id AS query_id, turn AS rank, trim(role || chr(10) || text) AS block FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, 600 - coalesce(sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM b)
SELECT query_id, string_agg(block[1:CAST(rest AS INT)], chr(10) || chr(10) ORDER BY rank) AS context FROM p WHERE rest > 0 GROUP BY query_id""",
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as context blocks under a budget of 600 characters."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return retrieval.context_of(c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.trim(F.concat_ws("\n", "role", "text")).alias("block")), 600)


@query(
    "index_routing",
    """SELECT c_custkey AS course_id, CASE WHEN c_nationkey % 5 < 3 THEN ['ai', 'hss', 'bme'][c_nationkey % 5 + 1] WHEN n_regionkey < 3 THEN 'hss' ELSE 'ai' END AS major,
  array_to_string(list_concat(CASE WHEN n_regionkey < 3 THEN ['lecture'] WHEN c_nationkey % 5 < 3 THEN ['major_' || ['ai', 'hss', 'bme'][c_nationkey % 5 + 1]] ELSE ['major_ai'] END,
    CASE WHEN c_custkey % 4 = 0 THEN ['course_' || c_custkey] ELSE [] END), ',') AS indexes
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def index_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Major and indexes of each course by stored major, route and default."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    stored = F.get(F.array(F.lit("ai"), F.lit("hss"), F.lit("bme")), (F.col("c_nationkey") % 5).cast("int"))
    own = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("course_"), F.col("c_custkey").cast("string")))
    courses = c.select(F.col("c_custkey").alias("course_id"), stored.alias("stored_major"), own.alias("own_index"))
    routes = c.where("n_regionkey < 3").select(F.col("c_custkey").alias("course_id"), F.lit("hss").alias("route_major"), F.array(F.lit("lecture")).alias("route_indexes"))
    out = retrieval.indexes_for(courses, routes, "ai", {"ai": "major_ai", "hss": "major_hss", "bme": "major_bme"})
    return out.withColumn("indexes", F.array_join("indexes", ","))


@query(
    "normalised_uplift",
    _RANKS
    + """SELECT round(avg(CASE WHEN raw <= 1 THEN 1.0 ELSE 0.0 END), 6) AS raw_1, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS normalised_1,
  round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN raw <= 1 THEN 1.0 ELSE 0.0 END), 6) AS gain_1,
  round(avg(CASE WHEN raw <= 5 THEN 1.0 ELSE 0.0 END), 6) AS raw_5, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS normalised_5,
  round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN raw <= 5 THEN 1.0 ELSE 0.0 END), 6) AS gain_5
FROM (SELECT *, first_rank + query_id % 3 AS raw FROM ranks) WHERE n_answers > 0""",
)
def normalised_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What normalised queries gain over raw ones, whose first answer stands lower here for some."""
    ranks = _ranks(spark, sf_dir)
    return evaluation.uplift(ranks.withColumn("first_rank", F.col("first_rank") + F.col("query_id") % 3), ranks)


@query(
    "router_confusion",
    _HITS
    + """, t AS (SELECT query_id, max(score) AS top FROM hits GROUP BY query_id),
r AS (SELECT ['on', 'off', 'either'][(query_id // 100) % 3 + 1] AS expected, top >= 0.5 AND query_id % 200 = 0 AS use_rag, query_id % 200 = 0 AND top < 0.5 AS gated FROM t)
SELECT count(*) FILTER (expected = 'on' AND use_rag) AS true_on, count(*) FILTER (expected = 'on' AND NOT use_rag) AS false_off, count(*) FILTER (expected = 'off' AND use_rag) AS false_on,
  count(*) FILTER (expected = 'off' AND NOT use_rag) AS true_off, count(*) FILTER (gated) AS gated_off,
  round(avg(CASE WHEN expected <> 'either' THEN CASE WHEN (expected = 'on') = use_rag THEN 1.0 ELSE 0.0 END END), 6) AS accuracy FROM r""",
)
def router_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of trigger and score gate against what was expected."""
    tops = retrieval.merged_hits(_hits(spark, sf_dir)).groupBy("query_id").agg(F.max("score").alias("top"))
    triggered = F.col("query_id") % 200 == 0
    expected = F.get(F.array(F.lit("on"), F.lit("off"), F.lit("either")), (F.floor(F.col("query_id") / 100) % 3).cast("int"))
    return evaluation.confusion(tops.select(expected.alias("expected"), retrieval.gated(triggered, F.col("top"), 0.5).alias("use_rag"), (triggered & (F.col("top") < 0.5)).alias("gated")))


@query(
    "off_responses",
    _HITS
    + """, t AS (SELECT query_id, max(score) AS top FROM hits GROUP BY query_id), a AS (SELECT vec_id AS query_id, vec_id % 300 = 0 AS on_, vec_id % 400 <> 0 AS found FROM embeddings WHERE vec_id % 100 = 0)
SELECT a.query_id, CASE WHEN NOT on_ THEN 'NO_TRIGGER' WHEN NOT found THEN 'NO_RESULTS' WHEN top >= 0.5 THEN 'ROUTED' ELSE 'SCORE_BELOW_THRESHOLD' END AS reason,
  found AND top >= 0.5 AND on_ AS use_rag, CASE WHEN on_ AND found THEN round(top, 4) END AS top_score FROM a JOIN t USING (query_id)""",
)
def off_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query with the reason why retrieval is on or off: no trigger, no results, a score below the threshold."""
    tops = retrieval.merged_hits(_hits(spark, sf_dir)).groupBy("query_id").agg(F.max("score").alias("top"))
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    on = F.col("top") >= 0.5
    answers = tops.where("query_id % 300 = 0 and query_id % 400 <> 0")
    answers = answers.select("query_id", F.when(on, "ROUTED").otherwise("SCORE_BELOW_THRESHOLD").alias("reason"), on.alias("use_rag"), F.bround("top", 4).alias("top_score"))
    return retrieval.with_reasons(asked, asked.where("query_id % 300 = 0"), answers)
