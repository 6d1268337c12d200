"""Sources: chunk and latency lines, query sets, page texts, lexicons, glossaries, recogniser events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "struct<week:int,slide_title:string,page_range:array<int>,chapter:string,section_title:string,field:string,field_en:string,term:string,materialId:string>"
CHUNK = f"chunk_id string, source string, doc_type string, text string, metadata {METADATA}"
CAPTION = (
    "kind string, sessionId string, segmentId string, sequence int, locale string, chars int, skipped boolean, sttMs double, segmentMs double,"
    " queueMs double, translateSlotMs double, glossaryMs double, ragMs double, translateMs double, translateTtftMs double, firstLocaleMs double,"
    " localeReadyMs map<string,double>, orderWaitMs double, emitMs double, workerMs double, e2eFirstCaptionMs double, e2eCaptionMs double,"
    " streaming boolean, ttsQueueMs double, ttsSynthMs double, ttsFirstChunkMs double, ttsPlayWaitMs double, ttsPublishMs double,"
    " e2eFirstAudioMs double, e2eAudioMs double"
)
QUERY = "query string, answer_chunk_ids array<string>, query_type string"
LEXICON = (
    "major string, label string, index string, score_threshold double, transliterations map<string,string>,"
    " lexicon array<struct<pattern:string,canonical:string,reason:string>>, pattern_exclusions map<string,array<string>>, filler_patterns array<string>"
)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines; blank ones are skipped, a missing file is an error."""
    return spark.read.schema(CHUNK).json(path)


def latency_records(spark: SparkSession, path: str) -> DataFrame:
    """Latency lines; malformed ones are kept apart by ``bad_line``."""
    return spark.read.schema(f"{CAPTION}, bad_line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)


def good(records: DataFrame) -> DataFrame:
    return records.where("bad_line is null").drop("bad_line")


def bad_lines(records: DataFrame) -> int:
    """Number of malformed lines."""
    held = records.select("bad_line").persist()  # the JSON reader refuses a query of the bad column alone
    try:
        return held.where("bad_line is not null").count()
    finally:
        held.unpersist()


def query_sets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON arrays of evaluation queries with their ``source`` file; an ill-formed query is an error when read."""
    rows = spark.read.option("multiLine", True).schema(QUERY).json(paths).withColumn("source", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1))
    ok = (F.coalesce(F.trim("query"), F.lit("")) != "") & F.col("answer_chunk_ids").isNotNull()
    return rows.where(F.assert_true(ok, F.lit("a query needs text and a list of answers")).isNull())


def positives(queries: DataFrame) -> DataFrame:
    return queries.where(F.size("answer_chunk_ids") > 0)


def negatives(queries: DataFrame) -> DataFrame:
    return queries.where(F.size("answer_chunk_ids") == 0)


def first_queries(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """Queries of several files in file order, the first ``limit`` of them."""
    parts = [spark.read.option("multiLine", True).schema(QUERY).json(p).withColumns({"_f": F.lit(k), "_r": F.monotonically_increasing_id()}) for k, p in enumerate(paths)]
    out = reduce(DataFrame.unionByName, parts).orderBy("_f", "_r")
    return (out.limit(limit) if limit else out).drop("_f", "_r")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_no, text) of text files with form feeds between pages."""
    whole = spark.read.text(path, wholetext=True).withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return whole.select("doc_id", F.posexplode(F.split("value", "\f")).alias("_p", "text")).select("doc_id", (F.col("_p") + 1).alias("page_no"), "text")


def keyed_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, page_no, text) of ``write_page_texts``'s files; the key is a string."""
    parts = F.split("value", "\f")
    pages = spark.read.option("lineSep", "\x00").text(path).select(F.nullif(parts[0], F.lit("")).alias("key"), F.posexplode(F.slice(parts, 2, F.size(parts))).alias("_p", "text"))
    text = F.replace(F.replace("text", F.lit("\x01a"), F.lit("\x00")), F.lit("\x01b"), F.lit("\x01"))
    return pages.select("key", (F.col("_p") + 1).alias("page_no"), text.alias("text"))


def vector_index(spark: SparkSession, path: str, course_id: str | None = None) -> DataFrame:
    """Index folders; one course's alone is a pruned partition."""
    rows = spark.read.parquet(path)
    return rows if course_id is None else rows.where(F.col("course_id") == course_id)


def lexicons(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(major, ord, pattern, canonical, reason, exclusions) and (major, spoken, written) of lexicon files."""
    raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(LEXICON).json(path).where("major is not null")
    patterns = raw.select("major", "pattern_exclusions", F.posexplode("lexicon").alias("ord", "l"))
    patterns = patterns.select("major", "ord", "l.pattern", "l.canonical", "l.reason", F.col("pattern_exclusions")[F.col("l.pattern")].alias("exclusions"))
    return patterns, raw.select("major", F.explode("transliterations").alias("spoken", "written"))


def glossary(raw: DataFrame) -> DataFrame:
    """Entries of a JSON array in column ``value``; blank terms go, unreadable text is an empty glossary."""
    entry = "array<struct<term:string,pronunciation:string,definition:string,translations:map<string,string>>>"
    return raw.select("course_id", F.inline(F.coalesce(F.from_json("value", entry), F.array().cast(entry)))).where("trim(term) <> ''")


def session_configs(status: DataFrame, configs: DataFrame, locales: tuple[str, ...]) -> DataFrame:
    """Active sessions with their validated configuration: an unknown locale rejects the session."""
    live = status.where("status = 'active'").join(configs, "session_id")
    known = F.forall("target_locales", lambda x: x.isin(*locales))
    return live.where((F.size("target_locales") > 0) & known)


def voiced_locales(locales: Column, supported: tuple[str, ...], voices: tuple[str, ...]) -> Column:
    """Locales with a voice; null if one is unsupported or none is left."""
    kept = F.filter(locales, lambda x: x.isin(*voices))
    return F.when(F.forall(locales, lambda x: x.isin(*supported)) & (F.size(kept) > 0), kept)


def recogniser_results(raw: DataFrame) -> DataFrame:
    """Confidence and milliseconds of detailed recogniser results (JSON in column ``value``)."""
    got = F.from_json("value", "NBest array<struct<Confidence:double>>, Offset bigint, Duration bigint, DisplayText string")
    e = raw.select(got.alias("e"))
    return e.select(F.col("e.DisplayText").alias("text"), F.get("e.NBest.Confidence", F.lit(0)).alias("confidence"), F.expr("e.Offset div 10000").alias("offset_ms"), F.expr("e.Duration div 10000").alias("duration_ms"))


def realtime_events(raw: DataFrame) -> DataFrame:
    """Recogniser events by kind: deltas, completed texts with pseudo-confidence, failures."""
    e = raw.select(F.from_json("value", "type string, item_id string, delta string, transcript string, logprobs array<struct<logprob:double>>").alias("e")).select("e.*")
    kind = F.when(F.col("type").endswith(".delta"), "delta").when(F.col("type").endswith(".completed"), "completed").when(F.col("type").contains("failed") | (F.col("type") == "error"), "failed").otherwise("other")
    return e.withColumn("kind", kind)


def wav_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, reference) of sound files that have a transcript of the same name."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    sound = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select(stem.alias("name"), "content")
    text = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(stem.alias("name"), F.decode("content", "UTF-8").alias("reference"))
    return sound.join(text, "name")


def course_routes(raw: Column, majors: tuple[str, ...], indexes: tuple[str, ...]) -> Column:
    """Map of course -> (major, indexes) from JSON; an unknown name or an empty list is an error when run."""
    parsed = F.from_json(raw, "map<string,struct<major:string,indexes:array<string>>>")
    ok = F.forall(F.map_values(parsed), lambda v: v["major"].isin(*majors) & (F.size(v["indexes"]) > 0) & F.forall(v["indexes"], lambda x: x.isin(*indexes)))
    return F.when(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("the course map names an unknown major or index")).isNull(), parsed)


def is_pdf(mime: Column, filename: Column, url: Column) -> Column:
    """By the type if there is one, else by the file name, else by the URL's path."""
    ends = lambda c: F.lower(F.regexp_replace(c, r"[?#].*$", "")).endswith(".pdf")
    return F.when(mime.isNotNull(), mime == "application/pdf").when(filename.isNotNull(), ends(filename)).otherwise(F.coalesce(ends(url), F.lit(False)))


def is_pdf_content(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")
