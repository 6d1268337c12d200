"""Round trips of sources and sinks: rows of a table written to the shared folder in the formats of the files, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions import maps, text
from chalkline.operators import latency, report
from chalkline.registry import query
from chalkline.session import ensure_checkpoint_dir, table
from chalkline.sources import readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "chunk_lines",
    """SELECT 'd_' || doc_id AS chunk_id, source, lang AS doc_type, sha256(text) AS text, doc_id % 15 AS week, CASE WHEN doc_id % 2 = 0 THEN source END AS chapter FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""",
)
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunk lines with unique ids, blank lines between them, and back."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    metadata = F.struct((F.col("doc_id") % 15).cast("int").alias("week"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("chapter"))
    made = d.select(F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("chunk_id"), "source", F.col("lang").alias("doc_type"), "text", metadata.alias("metadata"))
    path = _folder(spark, "chunks")
    writers.write_chunks(made, path)
    spark.createDataFrame([("",), ("  ",)], "value string").write.mode("append").text(path)
    read = readers.chunks(spark, path).where("chunk_id is not null")
    return read.select("chunk_id", "source", "doc_type", F.sha2("text", 256).alias("text"), F.col("metadata.week").cast("long").alias("week"), F.col("metadata.chapter").alias("chapter"))


@query(
    "latency_lines",
    """SELECT event_type AS kind, CAST(event_id AS VARCHAR) AS segmentId, CASE WHEN event_id % 3 <> 0 THEN value END AS sttMs, value > 50 AS skipped FROM events WHERE event_id % 11 <> 0""",
)
def latency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements as JSON lines without null members, some of them cut off, read back without the malformed ones."""
    e = table(spark, sf_dir, "events")
    record = e.select(
        F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("segmentId"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("sttMs"), (F.col("value") > 50).alias("skipped")
    )
    path = _folder(spark, "latency")
    writers.append_lines(record.where("cast(segmentId as long) % 11 <> 0"), path)
    broken = writers.json_lines(record.where("cast(segmentId as long) % 11 = 0")).select(F.concat(F.lit("{"), "value").alias("value"))
    broken.write.mode("append").text(path)
    return readers.good(readers.latency_records(spark, path)).select("kind", "segmentId", "sttMs", "skipped")


@query(
    "query_files",
    """SELECT text AS query, item_id % 5 AS n_answers, CASE WHEN item_id % 5 > 0 THEN 'positive' ELSE 'negative' END AS kind FROM benchmark WHERE trim(text) <> ''""",
)
def query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation queries as JSON, split into those with and without answers."""
    b = table(spark, sf_dir, "benchmark").where("trim(text) <> ''")
    answers = F.transform(F.sequence(F.lit(0), (F.col("item_id") % 5).cast("int")), lambda k: F.concat(F.lit("c"), k.cast("string")))
    path = _folder(spark, "queries")
    one = F.struct(F.col("text").alias("query"), F.slice(answers, 2, 9).alias("answer_chunk_ids"), F.lit("plain").alias("query_type"))
    arrays = b.groupBy(F.floor(F.col("item_id") / 50).alias("file")).agg(F.to_json(F.collect_list(one)).alias("value"))
    arrays.repartition("file").write.partitionBy("file").text(path)
    read = readers.query_sets(spark, [f"{path}/*"])
    one = lambda rows, kind: rows.select("query", F.size("answer_chunk_ids").cast("long").alias("n_answers"), F.lit(kind).alias("kind"))
    return one(readers.positives(read), "positive").unionByName(one(readers.negatives(read), "negative"))


@query(
    "built_indexes",
    """WITH s AS (SELECT * FROM (VALUES ('low', 0), ('low', 1), ('all', 0), ('all', 1), ('all', 2)) v(index_name, kind))
SELECT index_name, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings JOIN s ON label % 4 = kind GROUP BY index_name""",
)
def built_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of vectors by sets of document types; one that is ready stays as it is when it is built again."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 4).cast("string").alias("doc_type"))
    subsets = spark.createDataFrame([("low", "0"), ("low", "1"), ("all", "0"), ("all", "1"), ("all", "2")], "index_name string, doc_type string")
    path = _folder(spark, "indexes")
    writers.build_indexes(v, subsets, path)
    writers.build_indexes(v.limit(0), subsets, path)
    return readers.vector_index(spark, path).groupBy("index_name").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query(
    "lexicon_files",
    """SELECT 'm' || p_partkey // 100 AS major, p_name || ' ' || p_partkey AS pattern, p_name AS canonical, CASE WHEN p_size % 2 = 0 THEN 'TEXTBOOK' ELSE 'GLOSSARY_TERM' END AS reason,
  row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_name || ' ' || p_partkey) - 1 AS ord FROM part""",
)
def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicons of majors (a hundred parts each) exported sorted by pattern, one JSON a major and 200 to a file, and read back; a broken file is skipped."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), F.floor(key / 100).cast("string")).alias("major"), F.concat_ws(" ", "p_name", key.cast("string")).alias("pattern"),
        F.col("p_name").alias("canonical"), F.when(F.col("p_size") % 2 == 0, "TEXTBOOK").otherwise("GLOSSARY_TERM").alias("reason"),
    )
    path = _folder(spark, "lexicons")
    bundle = F.floor(F.substring("major", 2, 20).cast("long") / 200)
    arrays = writers.exported_lexicon(rows).groupBy(bundle.alias("b")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    files = arrays.select("value").unionByName(spark.createDataFrame([('{"major": "broken", "lexicon": [',)], "value string"))
    files.withColumn("file", F.xxhash64("value")).repartition("file").select("value", "file").write.partitionBy("file").text(path)
    patterns, _ = readers.lexicons(spark, f"{path}/*")
    return patterns.select("major", "pattern", "canonical", "reason", F.col("ord").cast("long").alias("ord"))


@query(
    "glossary_files",
    """SELECT p_partkey // 50 AS course_id, p_name AS term, p_brand AS definition FROM part WHERE p_partkey // 50 % 10 <> 3 AND p_partkey % 50 <> 7""",
)
def glossary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A course's glossary as one JSON array under its key: blank terms go, an unreadable one is empty."""
    key = F.col("p_partkey")
    entry = F.struct(F.when(key % 50 == 7, "  ").otherwise(F.col("p_name")).alias("term"), F.col("p_brand").alias("definition"))
    keyed = table(spark, sf_dir, "part").select(F.floor(key / 50).alias("course_id"), entry.alias("e")).groupBy("course_id").agg(F.to_json(F.collect_list("e")).alias("value"))
    raw = keyed.withColumn("value", F.when(F.col("course_id") % 10 == 3, "not json").otherwise(F.col("value")))
    return readers.glossary(raw).select("course_id", "term", "definition")


@query(
    "page_files",
    """WITH p AS (SELECT conv_id, text FROM (SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id))
SELECT conv_id, generate_subscripts(string_split(text, chr(12)), 1) AS page_no, sha256(unnest(string_split(text, chr(12)))) AS digest FROM p""",
)
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts with form feeds between pages, many to a file, read back as pages."""
    path = _folder(spark, "pages")
    writers.write_page_texts(table(spark, sf_dir, "conversations").where("text is not null"), path, "conv_id", "turn", "text")
    pages = readers.keyed_page_texts(spark, path)
    return pages.select(F.col("key").cast("long").alias("conv_id"), F.col("page_no").cast("long").alias("page_no"), F.sha2("text", 256).alias("digest"))


@query(
    "course_maps",
    """SELECT c_custkey AS course_id, 'hss' AS major, 'lecture,course_' || c_custkey AS indexes FROM customer WHERE c_custkey % 10 = 0""",
)
def course_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses with their major and indexes from JSON, validated: an unknown name is an error."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0")
    key = F.col("c_custkey").cast("string")
    raw = F.concat(F.lit('{"'), key, F.lit('":{"major":"hss","indexes":["lecture"]}}'))
    parsed = c.select("c_custkey", F.explode(readers.course_routes(raw, ("ai", "hss"), ("lecture",))).alias("k", "v"))
    return parsed.select(F.col("c_custkey").alias("course_id"), "v.major", F.concat_ws(",", "v.indexes", F.concat(F.lit("course_"), "k")).alias("indexes"))


@query(
    "locale_schema",
    """SELECT conv_id, turn, 'o ' || role AS en, CASE WHEN turn % 2 = 0 THEN 'x' ELSE '' END AS ja FROM conversations WHERE role IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL""",
)
def locale_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that follow the strict schema of the wanted locales, as columns."""
    c = table(spark, sf_dir, "conversations").where("role is not null and conv_id is not null and turn is not null")
    raw = F.to_json(F.struct(F.concat(F.lit("o "), "role").alias("en-US"), F.when(F.col("turn") % 2 == 0, "x").alias("ja-JP")))
    en, ja = maps.parsed_locales(raw, ["en-US", "ja-JP"])
    return c.select("conv_id", "turn", en.alias("en"), ja.alias("ja"))


@query(
    "latency_report",
    """WITH a AS (SELECT event_type, count(*) AS n, quantile_cont(value::DOUBLE, 0.5) AS p50, quantile_cont(value::DOUBLE, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type),
r AS (SELECT row_number() OVER (ORDER BY event_type) + 4 AS line_no, '| ' || event_type || ' | ' || format('{:,.1f}', round(p50, 6)) || ' | ' || format('{:,.1f}', round(p95, 6)) || ' | ' || n || ' |' AS line FROM a)
SELECT * FROM r UNION ALL SELECT * FROM (VALUES (1, '## Latency'), (2, ''), (3, '| stage | p50 | p95 | n |'), (4, '|---|---|---|---|')) v(line_no, line)""",
)
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of stages as the lines of a report, written as text and read back."""
    p = latency.percentiles(table(spark, sf_dir, "events"), "event_type", "value")
    columns = {"stage": report.cell(F.col("event_type")), "p50": report.cell(F.col("p50"), 1), "p95": report.cell(F.col("p95"), 1), "n": report.cell(F.col("n"))}
    lines = report.markdown_table(p, "Latency", [F.col("event_type")], columns)
    path = _folder(spark, "report")
    lines.orderBy("line_no").coalesce(1).select(F.concat_ws("\t", F.col("line_no").cast("string"), "line").alias("value")).write.text(path)
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("line_no"), parts[1].alias("line"))


@query(
    "repaired_names",
    """SELECT page_id, regexp_extract(url, '[^/]*$') || 'é' AS name FROM pages WHERE url IS NOT NULL""",
)
def repaired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names whose UTF-8 bytes were read as Latin-1, read again."""
    name = F.concat(F.regexp_extract("url", "[^/]*$", 0), F.lit("é".encode().decode("latin-1")))
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", text.repaired_filename(name).alias("name"))


@query(
    "chapter_sidecar",
    """SELECT p_partkey // 100 AS book, CAST(p_partkey % 100 AS VARCHAR) AS chapter_no, p_name AS title, p_type AS part, p_brand AS field FROM part""",
)
def chapter_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar of each book's chapters as one JSON object, written and read back by chapter."""
    key = F.col("p_partkey")
    chapters = table(spark, sf_dir, "part").select(
        F.floor(key / 100).alias("book"), (key % 100).cast("int").alias("chapter_no"), F.col("p_name").alias("title"), F.col("p_type").alias("part"),
        F.col("p_brand").alias("field"), F.lit(None).cast("string").alias("field_en"), F.split("p_name", " ").alias("key_terms"),
    )
    path = _folder(spark, "sidecar")
    writers.chapter_sidecar(chapters, "book").write.parquet(path)
    read = spark.read.parquet(path).select("book", F.from_json("value", "chapters map<string,struct<title:string,part:string,field:string>>").alias("v"))
    return read.select("book", F.explode("v.chapters").alias("chapter_no", "c")).select("book", "chapter_no", "c.title", "c.part", "c.field")
