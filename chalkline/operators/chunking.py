"""Chunking of documents: clean lines, slide merge, sections, overlap split, sidecars, key terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chalkline.operators.ordered import filled, merged_islands

_AFTER_POINT = re.compile(r"(?<=\.)[ \t\n\x0b\f\r]+")
MIN_SLIDE_CHARS, SECTION_TOKENS, OVERLAP_TOKENS = 50, 500, 50


def clean_lines(text: Column, drop: tuple[str, ...] = (), drop_single: bool = False) -> Column:
    """Trimmed lines without blank, punctuation-only and dropped ones."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x))

    def kept(line: Column) -> Column:
        ok = (line != "") & line.rlike(r"[\p{L}\p{N}]")
        if drop_single:
            ok = ok & (F.length(line) > 1)
        for pattern in drop:
            ok = ok & ~line.rlike(pattern)
        return ok

    return F.filter(lines, kept)


def lecture_slides(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_no, week, title, body) of pages that begin with ``WeekN`` and have a title; others go."""
    lines = clean_lines(F.col("text"))
    out = pages.withColumn("_l", lines).withColumn("_w", F.regexp_extract(F.get("_l", F.lit(0)), r"^Week\s*(\d+)", 1))
    out = out.where((F.col("_w") != "") & (F.size("_l") >= 2))
    return out.select(key, "page_no", F.col("_w").cast("int").alias("week"), F.get("_l", F.lit(1)).alias("title"), F.array_join(F.slice("_l", 3, 100_000), "\n").alias("body"))


def deck_slides(pages: DataFrame, key: str = "doc_id", drop: tuple[str, ...] = (), drop_single: bool = False, header=None) -> DataFrame:
    """(key, page_no, title, body) with a page as a slide; ``header``: lines -> (title, body lines)."""
    out = pages.withColumn("_l", clean_lines(F.col("text"), drop, drop_single)).where(F.size("_l") > 0)
    title, body = header(F.col("_l")) if header else (F.get("_l", F.lit(0)), F.slice("_l", 2, 100_000))
    return out.select(key, "page_no", title.alias("title"), F.array_join(body, "\n").alias("body"))


def numbered_header(lines: Column) -> tuple[Column, Column]:
    """Title and body of a slide with a head of three lines: ``1 Unit``, its number alone, and a heading. The number is
    that of the second line; other slides have their first line as title. Used as ``header`` of ``deck_slides``."""
    unit = F.regexp_extract(F.get(lines, F.lit(0)), r"^[0-9]+\s+(\S.*)$", 1)
    number = F.get(lines, F.lit(1))
    headed = (F.size(lines) >= 3) & number.rlike("^[0-9]+$") & (unit != "")
    title = F.concat(number, F.lit(". "), unit, F.lit(" — "), F.get(lines, F.lit(2)))
    return F.when(headed, title).otherwise(F.get(lines, F.lit(0))), F.when(headed, F.slice(lines, 4, 100_000)).otherwise(F.slice(lines, 2, 100_000))


def merged_slides(slides: DataFrame, keys: list[str], least: int = MIN_SLIDE_CHARS) -> DataFrame:
    """Consecutive pages of one title as one slide; slides under ``least`` characters go."""
    return merged_islands(slides, keys, "page_no", "title", "body", least)


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, key: str, chapter: str, section: str, text: str = "text") -> DataFrame:
    """(key, chapter, section_no, section, body): line state by patterns, carried forward.

    A chapter's lines before its first section are section 0. Section numbers count sections.
    """
    lines = lines_of(docs, key, text)
    lines = lines.withColumns({"_c": F.when(F.col("line").rlike(chapter), F.col("line")), "_s": F.when(F.col("line").rlike(section), F.col("line"))})
    lines = filled(lines, [key], "line_no", "_c", "chapter")
    in_order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("chapter_no", F.count("_c").over(in_order))
    inside = Window.partitionBy(key, "chapter_no").orderBy("line_no")
    lines = lines.withColumns({"section_no": F.count("_s").over(inside), "section": F.last("_s", True).over(inside)})
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    out = lines.where("_c is null and _s is null").groupBy(key, "chapter_no", "chapter", "section_no", "section")
    return out.agg(F.trim(F.array_join(body, "\n")).alias("body")).where("body <> ''")


def overlap_parts(text: str, most: int = SECTION_TOKENS, overlap: int = OVERLAP_TOKENS) -> Iterator[str]:
    """Parts of a text over ``most`` tokens: whole sentences, each part after the first begun by the end
    (twice ``overlap`` characters) of the one before."""
    tokens = lambda n: max(1, n // 2)
    if tokens(len(text)) <= most:
        yield text
        return
    current = ""
    for sentence in _AFTER_POINT.split(text):
        if current and tokens(len(current) + 1 + len(sentence)) > most:
            yield current
            current = f"{current[-2 * overlap :]} {sentence}"
        else:
            current = f"{current} {sentence}".strip(" ")
    if current:
        yield current


def overlap_chunks(docs: DataFrame, key: str, text: str = "text", most: int = SECTION_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(key, part from 1, text) of all texts; a task holds one part of a text beside the text."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text"))
    schema = StructType([rows.schema[key], StructField("part", LongType()), StructField("text", StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                parts = list(overlap_parts(batch.column(1)[at].as_py(), most, overlap))
                keys = batch.column(0).take(pa.array([at] * len(parts), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(1, len(parts) + 1), pa.int64()), pa.array(parts, pa.string())], [key, "part", "text"])

    return rows.mapInArrow(split, schema)


def with_sidecar(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """``chunks`` with field and field_en of the chapter number in their id."""
    no = F.regexp_extract("chunk_id", r"_ch(\d+)", 1)
    number = F.when(no != "", no.cast("int"))
    meta = chapters.select(F.col("chapter_no").alias("_no"), "field", "field_en")
    return chunks.withColumn("_ch", number).join(meta, F.col("_ch") == F.col("_no"), "left").drop("_ch", "_no")


def split_key_terms(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """The first terms chunk of each chapter becomes one chunk for each key term; its siblings go."""
    no = F.regexp_extract("chunk_id", r"_ch(\d+)_terms", 1)
    marked = chunks.withColumn("_no", F.when(no != "", no.cast("int")))
    known = chapters.where(F.size("key_terms") > 0).select(F.col("chapter_no").alias("_c"), "key_terms")
    joined = marked.join(known, F.col("_no") == F.col("_c"), "left")
    rest = joined.where("_c is null").select(*chunks.columns)
    first = joined.where("_c is not null").withColumn("_n", F.row_number().over(Window.partitionBy("_c").orderBy("chunk_id"))).where("_n = 1")
    terms = first.select("*", F.posexplode("key_terms").alias("_k", "_t"))
    base = F.regexp_extract("chunk_id", r"^(.*_ch\d+)_terms", 1)
    made = {"chunk_id": F.format_string("%s_term%02d", base, F.col("_k") + 1), "text": F.concat_ws(": ", "_t.term", "_t.desc")}
    return rest.unionByName(terms.select(*[made[c].alias(c) if c in made else F.col(c) for c in chunks.columns]))


def glossary_chunks(terms: DataFrame) -> DataFrame:
    """One chunk for each term, with its related terms by name (an unknown id stays as it is).

    ``terms``: (id, ko, en, definition, related array of ids).
    """
    names = terms.select(F.col("id").alias("_id"), F.col("ko").alias("_name"))
    links = terms.select("id", F.posexplode_outer("related").alias("_k", "_rel")).join(names, F.col("_rel") == F.col("_id"), "left")
    named = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_name", "_rel").alias("n")))), lambda x: x["n"])
    links = links.where("_rel is not null").groupBy("id").agg(F.array_join(named, ", ").alias("_related"))
    label = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    text = F.concat_ws("\n", label("term", F.col("ko")), label("english", F.col("en")), label("definition", F.col("definition")), label("related", F.col("_related")))
    return terms.join(links, "id", "left").select(F.concat(F.lit("term_"), "id").alias("chunk_id"), text.alias("text"))


def with_fallback(slides: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Slide chunks, and document chunks of the sources that gave no slide."""
    return slides.unionByName(documents.join(slides.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def hit_payload(hits: DataFrame) -> DataFrame:
    """Section title of a hit: its section, else its chapter, else ''; empty strings fall through too."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return hits.withColumns({"section_title": F.coalesce(blank("section_title"), blank("chapter"), F.lit("")), "score": F.bround("score", 4)})


def with_defaults(chunks: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``chunks`` with a default in each named column that is null."""
    return chunks.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def textbook_blocks(docs: DataFrame, key: str, chapter: str, section: str, summary: str, terms: str, text: str = "text") -> DataFrame:
    """(key, chapter_no, block, section_no, body): intro, sections, summary and terms of each chapter, by line patterns.

    The lines of a chapter belong to the last marker above them; those before its first marker are the intro. Lines
    above the first chapter go. Sections are numbered within their chapter; other blocks have the number 0.
    """
    lines = lines_of(docs, key, text)
    marker = F.when(F.col("line").rlike(chapter), "intro").when(F.col("line").rlike(section), "section").when(F.col("line").rlike(summary), "summary").when(F.col("line").rlike(terms), "terms")
    in_order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("_m", marker).withColumns({"block": F.last("_m", True).over(in_order), "chapter_no": F.count_if(F.col("_m") == "intro").over(in_order)})
    inside = Window.partitionBy(key, "chapter_no").orderBy("line_no")
    lines = lines.withColumn("section_no", F.when(F.col("block") == "section", F.count_if(F.col("_m") == "section").over(inside)).otherwise(0).cast("long"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    out = lines.where("_m is null and chapter_no > 0").groupBy(key, "chapter_no", "block", "section_no")
    return out.agg(F.trim(F.array_join(body, "\n")).alias("body")).where("body <> ''")
