"""Sinks: chunk lines, vector indexes, latency lines, snapshots, sidecars and lexicon exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.operators.relational import unique_or_fail


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk lines with unique ids; a duplicate fails the write."""
    unique_or_fail(chunks, "chunk_id").write.mode("overwrite").json(path)


def chunk_stats(chunks: DataFrame, *more: Column) -> DataFrame:
    """Count and text lengths by document type, and further aggregates in the same pass."""
    n = F.length("text")
    return chunks.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), *more)


def build_indexes(vectors: DataFrame, subsets: DataFrame, path: str, force: bool = False) -> None:
    """Vectors by index name; ``subsets``: (index_name, doc_type). Ready folders stay unless forced."""
    rows = vectors.join(F.broadcast(subsets), "doc_type")
    rows.write.mode("overwrite" if force else "ignore").partitionBy("index_name").parquet(path)


def append_index(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("append").partitionBy("course_id").parquet(path)


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row; null members are left out."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def append_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("append").text(path)


def write_page_texts(pages: DataFrame, path: str, key: str, order: str, text: str) -> None:
    """Texts of each key, with form feeds between its pages, in one file a task: a zero byte ends a key's text, which begins with the key."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\f")
    marked = F.replace(F.replace(whole, F.lit("\x01"), F.lit("\x01b")), F.lit("\x00"), F.lit("\x01a"))
    value = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\f"), marked)
    pages.groupBy(key).agg(value.alias("value")).select("value").write.option("lineSep", "\x00").text(path)


def latest_status(status: DataFrame, key: str, at: str, now, seconds: int) -> DataFrame:
    """The newest status of each key that has not expired."""
    last = status.groupBy(key).agg(F.max_by(F.struct(*[c for c in status.columns if c != key]), at).alias("s")).select(key, "s.*")
    return last.where(F.col(at) > now - F.expr(f"interval {seconds} seconds"))


def chapter_sidecar(chapters: DataFrame, *by: str) -> DataFrame:
    """One row (one for each value of ``by``) with the map of chapter number -> title, part, field and key terms."""
    entry = F.struct(F.col("chapter_no"), F.struct("title", "part", "field", "field_en", "key_terms"))
    return chapters.groupBy(*by).agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("chapters"))).alias("value"))


def exported_lexicon(lexicon: DataFrame) -> DataFrame:
    """One row for each major with its patterns in order, as JSON."""
    rows = F.array_sort(F.collect_list(F.struct("pattern", "canonical", "reason")))
    return lexicon.groupBy("major").agg(F.to_json(F.struct(F.first("major").alias("major"), rows.alias("lexicon"))).alias("value"))
