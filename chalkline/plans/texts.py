"""Text queries: sentences, chunks, lexicon routing, phrase lists, names, paths and speech error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions import text
from chalkline.operators import chunking, evaluation, lexicon, ordered
from chalkline.operators.automaton import contained
from chalkline.registry import query
from chalkline.session import table


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_ENDS, _CLOSERS = ".!?。！？…", "[\"''”’)\\]】」』]*"


@query(
    "completed_sentences",
    f"""SELECT doc_id, len(regexp_extract_all(text, '[^{_ENDS}]*[{_ENDS}]+{_CLOSERS}')) AS n_sentences,
  regexp_matches(regexp_replace(text, '(?s)^.*[{_ENDS}]+{_CLOSERS}', ''), '^{_BLANK}$') AS complete FROM documents WHERE text IS NOT NULL""",
)
def completed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed sentences of all documents with a text, and whether nothing is left over."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"), (F.length(text.remainder(F.col("text"))) == 0).alias("complete"))


@query(
    "cut_at_length",
    """WITH t AS (SELECT item_id, trim(text) AS t FROM benchmark),
h AS (SELECT *, regexp_extract(t[1:61], '(?s)^(.{1,60}) ', 1) AS head FROM t)
SELECT item_id, CASE WHEN length(t) <= 60 THEN t WHEN head <> '' THEN trim(head) ELSE t[1:60] END AS head, CASE WHEN length(t) <= 60 THEN '' WHEN head <> '' THEN trim(t[length(head) + 1:]) ELSE trim(t[61:]) END AS tail FROM h""",
)
def cut_at_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a passage up to the last blank within 60 characters, and the rest."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", text.head_at(F.col("text"), 60).alias("head"), text.tail_at(F.col("text"), 60).alias("tail"))


@query(
    "overlap_chunks",
    r"""WITH RECURSIVE s AS (SELECT doc_id, text AS whole, string_split(regexp_replace(text, '\.[ \t\n\x0b\f\r]+', '.' || chr(0), 'g'), chr(0)) AS p FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, p, 1 AS i, 0 AS n, CAST(NULL AS VARCHAR) AS given, trim(p[1], ' ') AS cur FROM s WHERE greatest(1, length(whole) // 2) > 500
  UNION ALL SELECT doc_id, p, i + 1, n + is_full::INT, CASE WHEN is_full THEN cur END, CASE WHEN is_full THEN right(cur, 100) || ' ' || p[i + 1] ELSE trim(cur || ' ' || p[i + 1], ' ') END
  FROM (SELECT *, cur <> '' AND greatest(1, length(cur || ' ' || p[i + 1]) // 2) > 500 AS is_full FROM r WHERE i < len(p)))
SELECT format('doc{}_s{:02d}', doc_id, n) AS chunk_id, given AS text FROM r WHERE given IS NOT NULL
UNION ALL SELECT format('doc{}_s{:02d}', doc_id, n + 1), cur FROM r WHERE i = len(p) AND cur <> ''
UNION ALL SELECT format('doc{}_s01', doc_id), whole FROM s WHERE greatest(1, length(whole) // 2) <= 500""",
)
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in parts of at most 500 tokens with carried-over ends."""
    parts = chunking.overlap_chunks(table(spark, sf_dir, "documents"), "doc_id")
    return parts.select(F.format_string("doc%d_s%02d", "doc_id", "part").alias("chunk_id"), "text")


@query(
    "clean_lines",
    """SELECT doc_id, len(l) AS n_lines, array_to_string(l, chr(10)) AS body FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND regexp_matches(x, '[\\p{L}\\p{N}]') AND NOT regexp_matches(x, '^(Licensed|Released)')) AS l FROM documents WHERE text IS NOT NULL)
WHERE length(array_to_string(l, chr(10))) >= 50""",
)
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without blank, punctuation-only and licence lines; short ones go."""
    lines = chunking.clean_lines(F.col("text"), (r"^(Licensed|Released)",))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", lines.alias("l"))
    out = d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_join("l", "\n").alias("body"))
    return out.where(F.length("body") >= chunking.MIN_SLIDE_CHARS)


@query(
    "document_sections",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, count(*) FILTER (regexp_matches(line, '^The ')) OVER (PARTITION BY doc_id ORDER BY n) AS chapter_no FROM l)
SELECT doc_id, chapter_no, count(*) AS n_lines FROM m WHERE NOT regexp_matches(line, '^The ') AND line <> '' GROUP BY ALL""",
)
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each chapter, where a line that begins with a mark opens a chapter."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    out = chunking.sections(d, "doc_id", "^The ", "^\\u0000never")
    n = F.size(F.filter(F.split("body", "\n"), lambda x: x != ""))
    return out.groupBy("doc_id", "chapter_no").agg(F.sum(n.cast("long")).alias("n_lines"))


_LEXICON = """SELECT * FROM (VALUES (1, 'the', 'ARTICLE', 'SUPPLEMENT'), (2, 'er', 'er', 'SUPPLEMENT'), (3, 'which', 'WH', 'GLOSSARY_TERM'), (4, 'with', 'WH', 'TEXTBOOK'), (5, 'für', 'FÜR', 'GLOSSARY_TERM'), (6, 'de', 'DE', 'TEXTBOOK'))
  l(ord, pattern, canonical, reason)"""


def _lexicon(spark: SparkSession) -> DataFrame:
    rows = [(1, "the", "ARTICLE", "SUPPLEMENT"), (2, "er", "er", "SUPPLEMENT"), (3, "which", "WH", "GLOSSARY_TERM"), (4, "with", "WH", "TEXTBOOK"), (5, "für", "FÜR", "GLOSSARY_TERM"), (6, "de", "DE", "TEXTBOOK")]
    return spark.createDataFrame(rows, "ord long, pattern string, canonical string, reason string").withColumn("exclusions", F.lit(None).cast("array<string>"))


@query(
    "lexicon_route",
    f"""WITH lex AS ({_LEXICON}),
h AS (SELECT item_id, text, ord, canonical, reason FROM benchmark, lex WHERE CASE WHEN pattern = 'für' THEN contains(lower(text), pattern)
  ELSE regexp_matches(lower(text), '(^|[^A-Za-z0-9])' || pattern || '($|[^A-Za-z0-9])') END),
c AS (SELECT item_id, text, canonical, min(ord) AS o, coalesce(max(CASE WHEN reason = 'GLOSSARY_TERM' THEN reason END), arg_min(reason, ord)) AS reason FROM h GROUP BY ALL),
r AS (SELECT item_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, string_agg(DISTINCT canonical, ',' ORDER BY canonical) AS terms,
  string_agg(CASE WHEN NOT contains(lower(text), lower(canonical)) THEN canonical END, ' ' ORDER BY o) AS more FROM c GROUP BY item_id)
SELECT b.item_id AS sentence_id, terms IS NOT NULL AS use_rag, coalesce(reasons, '') AS reasons, coalesce(terms, '') AS terms,
  CASE WHEN terms IS NULL THEN text ELSE text || ' ' || coalesce(more, '') END AS query FROM benchmark b LEFT JOIN r ON b.item_id = r.item_id WHERE text IS NOT NULL""",
)
def lexicon_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers, reasons, terms and the widened query of each sentence."""
    s = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("sentence_id"), F.col("text").alias("sentence"))
    return lexicon.route(s, _lexicon(spark))


@query(
    "phrase_list",
    """WITH w AS (SELECT lang, doc_id, unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, doc_id % 3 AS priority, doc_id, k, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS phrase FROM w),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, lower(phrase) ORDER BY priority, doc_id, k) AS n FROM p WHERE length(phrase) BETWEEN 2 AND 30) WHERE n = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY priority, doc_id, k) AS i, sum(length(phrase)) OVER (PARTITION BY lang ORDER BY priority, doc_id, k ROWS UNBOUNDED PRECEDING) AS used FROM o)
SELECT lang, priority, doc_id, k, phrase FROM b WHERE i <= 50 AND used <= 400""",
)
def phrase_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised phrases of each language, once each, by priority, within the budget."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    p = lexicon.leading_phrases(d.select("lang", (F.col("doc_id") % 3).alias("priority"), "doc_id", "text"), ["lang"], "doc_id", 50)
    return lexicon.phrase_list(p, ["lang"], 50, 400).select("lang", "priority", "ord.doc_id", "ord.k", "phrase")


_EDITS = """cells AS (SELECT item_id, unnest(range(0, len(h) + 1)) AS j FROM p),
d AS (SELECT item_id, 0 AS i, j, j AS v FROM cells
  UNION ALL SELECT item_id, i + 1, j, min(c - j) OVER (PARTITION BY item_id ORDER BY j ROWS UNBOUNDED PRECEDING) + j
  FROM (SELECT d.item_id, d.i, d.j, least(d.v + 1, coalesce(lag(d.v) OVER (PARTITION BY d.item_id ORDER BY d.j) + CASE WHEN p.r[d.i + 1] = p.h[d.j] THEN 0 ELSE 1 END, d.i + 1)) AS c
        FROM d JOIN p ON p.item_id = d.item_id WHERE d.i < len(p.r))),
e AS (SELECT p.item_id, len(r) AS n, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE d.v / len(r) END AS rate FROM p JOIN d ON d.item_id = p.item_id AND d.i = len(p.r) AND d.j = len(p.h))"""
_OUT = r"""[\s.,!?;:"''“”‘’()\[\]{}·…~\-—啊。！？、，]+"""


@query(
    "speech_errors",
    f"""WITH RECURSIVE t AS (SELECT item_id, regexp_replace(lower(nfc_normalize(text)), '{_OUT}', '', 'g') AS t FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT a.item_id, CASE WHEN a.t = '' THEN [] ELSE string_split(a.t, '') END AS r, CASE WHEN b.t = '' THEN [] ELSE string_split(b.t, '') END AS h FROM t a JOIN t b ON b.item_id = a.item_id + 1), {_EDITS}
SELECT item_id, CAST(n AS BIGINT) AS ref_chars, round(rate, 6) AS cer FROM e""",
)
def speech_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of each passage against the next one."""
    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("heard"))
    p = b.join(other, "item_id").where("text is not null and heard is not null")
    p = p.select("item_id", text.compared(text.nfc("text")).alias("r"), text.compared(text.nfc("heard")).alias("h"))
    rate = evaluation.error_rate(F.levenshtein("r", "h"), F.length("r"), F.length("h"))
    return p.select("item_id", F.length("r").cast("long").alias("ref_chars"), F.round(rate, 6).alias("cer"))


@query(
    "weighted_errors",
    """SELECT lang AS engine, count(*) AS n, round(sum(n_chars / 100000.0 * length(text)) / sum(length(text)), 6) AS cer FROM documents GROUP BY lang""",
)
def weighted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-weighted error rate of each engine."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("lang").alias("engine")).agg(F.count(F.lit(1)).alias("n"), F.round(evaluation.weighted_error(F.col("n_chars") / 100000, F.length("text")), 6).alias("cer"))


@query(
    "page_names",
    """SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, regexp_extract(url, '^[^:]+://[^/]+/[^/?#]+/([^?#]*)', 1) AS blob,
  CASE WHEN starts_with(url, 'http://') THEN 'https://' || url[8:] ELSE url END AS rewritten,
  ends_with(lower(regexp_replace(url, '[?#].*$', '')), '.html') AS is_html FROM pages""",
)
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stems, blob names and rewritten URLs."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.without_extension(F.regexp_extract(url, "[^/]*$", 0)).alias("stem"), text.blob_name(url).alias("blob"),
        text.rewritten_url(url, "http://", "https://").alias("rewritten"), F.lower(F.regexp_replace(url, "[?#].*$", "")).endswith(".html").alias("is_html"),
    )


@query(
    "chunk_ids",
    """SELECT doc_id, format('src_p{:02d}_{:02d}', doc_id % 90, n_chars % 90) AS chunk_id, regexp_replace(regexp_replace(source || ' / ' || lang, '[^\\p{L}\\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g')[1:24] AS slug, 'a:' || doc_id || ':' || lang AS key FROM documents""",
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", text.chunk_id(F.lit("src"), F.col("doc_id") % 90, F.col("n_chars") % 90).alias("chunk_id"), text.slug(F.concat_ws(" / ", "source", "lang")).alias("slug"),
        text.dedupe_key(F.lit("a"), F.col("doc_id").cast("string"), F.col("lang")).alias("key"),
    )


@query(
    "sidecar_join",
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x_intro' ELSE 'x_ch' || (doc_id % 7) || '_s1' END AS chunk_id FROM documents)
SELECT doc_id, chunk_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 < 5 THEN 'field' || (doc_id % 7) END AS field FROM c""",
)
def sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter fields joined by the chapter number in a chunk's id."""
    number = F.col("doc_id").cast("string")
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x_intro").otherwise(F.format_string("x_ch%d_s1", F.col("doc_id") % 7)).alias("chunk_id"))
    chapters = spark.range(5).select(F.col("id").cast("int").alias("chapter_no"), F.concat(F.lit("field"), F.col("id").cast("string")).alias("field"), F.lit("x").alias("field_en"))
    return chunking.with_sidecar(chunks, F.broadcast(chapters)).select("doc_id", "chunk_id", "field")


@query(
    "first_wins",
    """SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL""",
)
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each source and language."""
    d = table(spark, sf_dir, "documents")
    return ordered.first_wins(d, F.concat_ws("|", "source", "lang"), ["doc_id"]).select("source", "lang", "doc_id")


@query(
    "speech_word_errors",
    f"""WITH RECURSIVE t AS (SELECT item_id, coalesce(list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '{_OUT}'), lambda w: w <> ''), []) AS t FROM benchmark),
p AS (SELECT a.item_id, a.t AS r, coalesce(b.t, []) AS h FROM t a LEFT JOIN t b ON b.item_id = a.item_id + 1 WHERE a.item_id IS NOT NULL), {_EDITS}
SELECT item_id, CAST(n AS BIGINT) AS n_words, round(rate, 6) AS wer FROM e""",
)
def speech_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of each passage against the next one; the last has none, so that its run counts as failed."""
    b = table(spark, sf_dir, "benchmark").where("item_id is not null")
    runs = evaluation.scored_runs(b.select("item_id", F.col("text").alias("reference")), b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis")), "item_id")
    words = lambda c: text.compared_words(text.nfc(c))
    p = runs.select("item_id", words("reference").alias("r"), words("hypothesis").alias("h"))
    return p.select("item_id", F.size("r").cast("long").alias("n_words"), F.round(evaluation.word_error_rate(F.col("r"), F.col("h")), 6).alias("wer"))


@query(
    "retriggered_routes",
    """WITH lex(ord, pattern, canonical) AS (VALUES (0, 'ou', 'or-term'), (1, 'sh', 'hush'), (2, 'ü', 'uml')),
a AS (SELECT item_id, text AS said FROM benchmark WHERE text IS NOT NULL),
own AS (SELECT DISTINCT item_id FROM a, lex WHERE CASE WHEN pattern = 'ü' THEN contains(lower(said), pattern) ELSE regexp_matches(lower(said), '(^|[^a-z0-9])' || pattern || '($|[^a-z0-9])') END),
h AS (SELECT item_id, string_agg(pattern, ' ' ORDER BY ord) AS hits FROM a, lex WHERE ord < 2 AND contains(said, pattern) GROUP BY item_id),
s AS (SELECT a.item_id, said, CASE WHEN own.item_id IS NULL THEN concat_ws(' ', said, hits) ELSE said END AS q FROM a LEFT JOIN own USING (item_id) LEFT JOIN h USING (item_id)),
m AS (SELECT item_id, string_agg(canonical, ',' ORDER BY canonical) AS terms, string_agg(CASE WHEN NOT contains(lower(q), canonical) THEN canonical END, ' ' ORDER BY ord) AS more FROM s, lex WHERE CASE WHEN pattern = 'ü' THEN contains(lower(q), pattern) ELSE regexp_matches(lower(q), '(^|[^a-z0-9])' || pattern || '($|[^a-z0-9])') END GROUP BY item_id)
SELECT item_id AS sentence_id, terms IS NOT NULL AS use_rag, coalesce(terms, '') AS terms, CASE WHEN terms IS NULL THEN said ELSE q || ' ' || coalesce(more, '') END AS query FROM s LEFT JOIN m USING (item_id)""",
)
def retriggered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that trigger nothing, tried again with the glossary terms that are anywhere in them, as words of their own."""
    s = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("sentence_id"), F.col("text").alias("sentence"))
    rows = [(0, "ou", "or-term", "TEXTBOOK", None), (1, "sh", "hush", "TEXTBOOK", None), (2, "ü", "uml", "TEXTBOOK", None)]
    lex = spark.createDataFrame(rows, "ord int, pattern string, canonical string, reason string, exclusions array<string>")
    hints = lexicon.glossary_hits(s, lex.where("ord < 2").select("ord", F.col("pattern").alias("term")))
    return lexicon.retriggered(lexicon.route(s, lex), hints, lex).select("sentence_id", "use_rag", "terms", "query")


@query(
    "textbook_blocks",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-F]') THEN 'intro' WHEN regexp_matches(line, '^[G-L]') THEN 'section' WHEN regexp_matches(line, '^[M-S]') THEN 'summary' WHEN regexp_matches(line, '^[T-Z]') THEN 'terms' END AS mark FROM l),
b AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS block, count(*) FILTER (mark = 'intro') OVER w AS chapter_no FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, CASE WHEN block = 'section' THEN count(*) FILTER (mark = 'section') OVER (PARTITION BY doc_id, chapter_no ORDER BY k ROWS UNBOUNDED PRECEDING) ELSE 0 END AS section_no FROM b)
SELECT * FROM (SELECT doc_id, chapter_no, block, section_no, trim(string_agg(line, chr(10) ORDER BY k), ' ') AS body FROM n WHERE mark IS NULL AND chapter_no > 0 GROUP BY ALL) WHERE body <> ''""",
)
def textbook_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intro, sections, summary and terms of chapters; the capital that begins a line of a document stands for a heading."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    return chunking.textbook_blocks(d, "doc_id", "^[A-F]", "^[G-L]", "^[M-S]", "^[T-Z]")


@query(
    "session_diagnostics",
    """WITH c AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id AS session, count(*) AS n_glossary FROM c WHERE role = 'user' AND turn > 1 GROUP BY ALL),
l AS (SELECT conv_id AS session, count(*) AS n_lexicon FROM c WHERE turn > 2 GROUP BY ALL),
p AS (SELECT conv_id AS session, count(*) AS n_phrases, sum(length(text))::BIGINT AS n_phrase_chars FROM c WHERE conv_id % 4 <> 1 GROUP BY ALL)
SELECT session, coalesce(n_glossary, 0) AS n_glossary, coalesce(n_lexicon, 0) AS n_lexicon, coalesce(n_phrases, 0) AS n_phrases, coalesce(n_phrase_chars, 0) AS n_phrase_chars
FROM g FULL JOIN l USING (session) FULL JOIN p USING (session)""",
)
def session_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each session's glossary, lexicon and phrase list, where a conversation's turns are its aids."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("phrase"))
    return lexicon.diagnostics(c.where("role = 'user' and turn > 1"), c.where("turn > 2"), c.where("session % 4 <> 1"), "session")


@query(
    "glossary_hints",
    """WITH g AS (SELECT * FROM (VALUES (0, 'the', 'article', 'en=the, ja=sono'), (1, 'er', '', 'de=er'), (2, 'ü', NULL, NULL), (3, 'de', NULL, 'fr=de')) v(ord, term, definition, pairs))
SELECT b.item_id AS sentence_id, coalesce((SELECT string_agg('- ' || term || CASE WHEN coalesce(definition, '') <> '' THEN ' (' || definition || ')' ELSE '' END || ' → ' || pairs, chr(10) ORDER BY ord)
  FROM g WHERE contains(b.text, g.term) AND pairs IS NOT NULL), '') AS hint FROM benchmark b WHERE b.text IS NOT NULL""",
)
def glossary_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translations that the glossary prescribes for the terms of a sentence; entries without any are left out."""
    s = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("sentence_id"), F.col("text").alias("sentence"))
    rows = [(0, "the", "article", {"ja": "sono", "en": "the"}), (1, "er", "", {"de": "er"}), (2, "ü", None, {}), (3, "de", None, {"fr": "de"})]
    entries = spark.createDataFrame(rows, "ord int, term string, definition string, translations map<string,string>")
    return lexicon.glossary_hints(lexicon.glossary_hits(s, entries.select("ord", "term")), entries)


@query(
    "large_lexicon",
    """WITH l AS (SELECT DISTINCT lower(w) AS pattern FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents WHERE doc_id % 2 = 0) WHERE length(w) BETWEEN 5 AND 12)
SELECT item_id AS sentence_id, count(*) AS n_patterns, min(pattern) AS first, max(pattern) AS last FROM benchmark b JOIN l ON contains(lower(b.text), l.pattern) GROUP BY item_id""",
)
def large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the words of documents that they contain, by automata of parts of the lexicon."""
    w = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.explode(F.split("text", " ")).alias("w")).where(F.length("w").between(5, 12))
    s = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sentence_id"), F.col("text").alias("sentence"))
    met = contained(s, w.select(F.lower("w").alias("pattern")).distinct(), "sentence", "pattern")
    return met.groupBy("sentence_id").agg(F.count("*").alias("n_patterns"), F.min("pattern").alias("first"), F.max("pattern").alias("last"))


@query(
    "slide_headers",
    """WITH c AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL),
x AS (SELECT conv_id, turn, role, list_filter(list_transform(l, lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')) AS l FROM c)
SELECT conv_id AS doc_id, turn AS page_no, CASE WHEN turn % 2 = 0 AND len(l) >= 1 THEN (turn + 1) || '. ' || role || ' — ' || l[1] ELSE turn || ' ' || role END AS title,
  array_to_string(CASE WHEN turn % 2 = 0 AND len(l) >= 1 THEN l[2:] ELSE list_concat([CASE WHEN turn % 2 = 0 THEN CAST(turn + 1 AS VARCHAR) ELSE 'no number' END], l) END, chr(10)) AS body FROM x""",
)
def slide_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as slides whose head has a unit, its number and a heading (even ones), or no number."""
    c = table(spark, sf_dir, "conversations").where("text is not null and conv_id is not null and turn is not null")
    head = F.concat(F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), F.when(F.col("turn") % 2 == 0, (F.col("turn") + 1).cast("string")).otherwise("no number"))
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.concat_ws("\n", head, "text").alias("text"))
    return chunking.deck_slides(pages, "doc_id", header=chunking.numbered_header)
