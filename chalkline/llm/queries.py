"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import decontaminate, fim, licenses, mix, perplexity, pii, quality, rollup, secrets, spelling, urls
from chalkline.llm.jaccard import jaccard_join
from chalkline.llm.packing import pack
from chalkline.llm.paths import tokenizer_path
from chalkline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of documents; counts and digest are of the base spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_pii(docs).drop("text")
    base = F.filter("pii_spans", lambda s: s["base"])
    counts = [F.size(F.expr(f"filter(pii_spans, s -> s.base and s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii_spans")).alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"),
    )


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, at similarity 0.8 of five-word sets."""
    return jaccard_join(table(spark, sf_dir, "documents"))


@query(
    "op3_quality",
    r"""
WITH g AS MATERIALIZED (
  SELECT doc_id, t, words, len(words) AS n, row_number() OVER () AS row,
         list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: [words[i], words[i + 1], words[i + 2]]) AS tri,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
p AS (SELECT row, i, tri[i] AS win FROM (SELECT row, tri, unnest(range(1, len(tri) + 1)) AS i FROM g)),
c AS (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS times FROM p),
r AS (SELECT row, count(DISTINCT i + k) AS n_repeat FROM c, (VALUES (0), (1), (2)) v(k) WHERE times > 1 GROUP BY row),
m AS (
  SELECT doc_id, t, n AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words
  FROM g LEFT JOIN r USING (row))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.5 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > len(string_split(t, chr(10)))
            OR 3 * len(regexp_extract_all(t, '\p{Lu}')) > 2 * word_chars
            OR 2 * len(regexp_extract_all(t, '!+')) > n_words) AS kept
FROM m
""",
)
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and the cascade's verdict for every text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents; counts and digest are of the base rules' spans.

    The documents reach the ledger in two batches, so the second one finds blobs of the first scanned.
    """
    versions = secrets.versions_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ledger = secrets.Ledger.fresh(spark)
    for k in range(2):
        ledger.commit(f"batch {k}", versions.where(F.pmod(F.xxhash64("path"), F.lit(2)) == k))
    found = ledger.findings().withColumn("findings", F.coalesce("findings", secrets.none_of(secrets.SPAN)))
    base = F.filter("findings", lambda s: s["rank"] < len(secrets.BASE))
    counts = [F.size(F.expr(f"filter(findings, s -> s.rule = '{k}')")).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"),
        F.size("findings").cast("long").alias("n_spans"),
    )


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False).drop("ids")


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, one row for each document and item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op4_token_rollup")
def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of documents: guessed counts are inserted first, then deleted for exact ones, each batch sent twice."""
    docs, totals = table(spark, sf_dir, "documents"), rollup.Rollup.fresh(spark)
    guesses = rollup.estimated(docs, "guess/1")
    exact = rollup.count_tokens(docs, tokenizer_path("word_bpe_49k.json"), "word_bpe_49k/1")
    for _ in range(2):
        totals.commit("arrived", rollup.inserts(guesses))
        totals.commit("counted", rollup.revisions(guesses, exact))
    return totals.totals()


@query(
    "op6_url_filter",
    r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
fit AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' ELSE 'allow' END AS verdict
FROM fit
""",
)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by the registered rules."""
    rules = spark.createDataFrame(urls.RULES, "rule_host string, rule_path string, action string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, and the verdict of its language's threshold."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return perplexity.classify(table(spark, sf_dir, "documents"), trusted)


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in the paragraphs of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query(
    "op11_fill_in_middle",
    r"""
WITH t AS MATERIALIZED (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tok, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
u AS (
  SELECT doc_id, t, tok, len(tok) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(tok) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(tok) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(tok[1:least(c1, c2)], ''), '') AS a,
         coalesce(array_to_string(tok[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS b, coalesce(array_to_string(tok[greatest(c1, c2) + 1:], ''), '') AS c
  FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""",
)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, with digests of the output and of the text rebuilt from it."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"),
    )


@query(
    "op12_mix",
    r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(sha256('mix/1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source)),
v AS (
  SELECT source, size, weight, 3 * sum(size) OVER () - 4 * (sum(size) OVER w - size) AS num, 2 * (sum(weight) OVER () - sum(weight) OVER w + weight) AS den
  FROM s WINDOW w AS (ORDER BY size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT source, size, weight, weight * num <= 2 * size * den AS shares,
         arg_max(struct_pack(num := num, den := den), den) FILTER (WHERE weight * num <= 2 * size * den) OVER () AS first
  FROM v),
t AS (SELECT source, size AS source_size, CASE WHEN shares THEN CAST(weight * first.num AS DOUBLE) / CAST(first.den AS DOUBLE) ELSE CAST(2 * size AS DOUBLE) END AS target FROM l)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (CAST(floor(target / source_size) AS BIGINT) + (u < target / source_size - floor(target / source_size))::BIGINT) END AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
""",
)
def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of 150% by weighted sources takes."""
    docs = mix.with_copies(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(
    "op13_spelling",
    r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
           translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, times, hex(doc_id || ':' || run) AS x FROM d),
h AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
                              lambda c, y: xor(t[xor(c, y) % 256 + 1], c >> 8))) AS h
  FROM b, tab),
w AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
c AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM c JOIN w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM c JOIN w ON c.rest = w.word),
f AS MATERIALIZED (
  SELECT word, any_value(n) AS n, count(other) AS n_near, CASE WHEN max(other_n) >= 5 * any_value(n) THEN first(other ORDER BY other_n DESC, other) END AS form,
         CASE WHEN max(other_n) >= 5 * any_value(n) THEN max(other_n) END AS form_n
  FROM w LEFT JOIN p USING (word) GROUP BY word),
r AS (SELECT word, word AS root FROM f UNION SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT r.word, r.root FROM r JOIN f ON r.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
""",
)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of documents with the form it is a variant of."""
    return spelling.variants(spelling.counted(spelling.words_of(table(spark, sf_dir, "documents"))))
