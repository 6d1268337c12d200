"""Expression queries: spoken text, terms, names, keys, JSON, locale maps, guards and small numbers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions import audio, maps, text, vectors
from chalkline.operators import chunking, lexicon, relational
from chalkline.registry import query
from chalkline.sources import readers, writers
from chalkline.session import table
from chalkline.streaming import jobs


def _picked(column, values: list[str]):
    """One of the values by a whole number."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(column, F.lit(len(values))).cast("int"))


# Sentences and fillers in Korean, put before the texts of conversations by the numbers of turns; SQL has the same list.
_SPOKEN = ["음 그러니까 디 엔 에 스 주소", "자 디엔에스은 이름을 찾습니다", "버퍼로 옮깁니다", "어 뭐시기 커널이 멈췄다", "씁 오늘 하 눈이 음", "바다은 넓다", "그 모듈을 인가 그 나눕니다"]
_SHOWN = ["음 그러니까 DNS 주소", "자 DNS은 이름을 찾습니다", "완충 공간으로 옮깁니다", "어 뭐시기 핵심부가 멈췄다", "씁 오늘 하 눈이 음", "바다은 넓다", "그 부품 틀을 인가 그 나눕니다"]
_listed = lambda values: "[" + ", ".join(f"'{s}'" for s in values) + "]"
_TERMS = [("디엔에스", "DNS"), ("버퍼", "완충 공간"), ("커널", "핵심부"), ("모듈", "부품 틀")]


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and text is not null")
    return c.select("conv_id", "turn", F.concat(_picked(F.col("conv_id") + F.col("turn"), _SPOKEN), F.lit(" "), F.col("text")).alias("said"))


@query(
    "spoken_queries",
    f"""WITH s AS (SELECT conv_id, turn, {_listed(_SPOKEN)}[(conv_id + turn) % 7 + 1] || ' ' || text AS said FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(said, '디\\s*엔\\s*에\\s*스', 'DNS', 'g'), '버\\s*퍼', '완충 공간', 'g'),
  '커\\s*널', '핵심부', 'g'), '모\\s*듈', '부품 틀', 'g') AS w FROM s),
f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '^(어|음|자|그|저)\\s+', ' ', 'g'), '그러니까\\s*', ' ', 'g'),
  '뭐시기\\s*', ' ', 'g'), '인가\\s+그\\s+', ' ', 'g'), '\\s+그거\\s+', ' ', 'g'), '\\s+그게\\s+', ' ', 'g') AS q FROM t)
SELECT conv_id, turn, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS query,
  array_to_string(list_filter(regexp_split_to_array(said, '\\s+'), lambda x: x <> '' AND NOT list_contains(['씁', '쓰읍', '음', '으음', '어', '아', '에', '엄', '흠', '하'], x)), ' ') AS plain FROM f""",
)
def spoken_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transliterations and fillers of spoken sentences as a search query; and stand-alone fillers removed."""
    s = _spoken(spark, sf_dir)
    return s.select("conv_id", "turn", text.spoken_query(F.col("said"), _TERMS).alias("query"), text.without_fillers(F.col("said")).alias("plain"))


@query(
    "display_corrections",
    f"""WITH s AS (SELECT conv_id, turn, text, (conv_id + turn) % 7 AS k FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, turn, {_listed(_SHOWN)}[k + 1] || ' ' || text AS shown, [1, 1, 1, 1, 0, 0, 1][k + 1]::BIGINT AS fixed FROM s""",
)
def display_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken terms as written ones, with particles that agree; the text behind them stays as it is."""
    got = text.display_correction(F.col("said"), _TERMS)
    return _spoken(spark, sf_dir).select("conv_id", "turn", got.alias("c")).select("conv_id", "turn", F.col("c.text").alias("shown"), F.col("c.fixed").alias("fixed"))


@query(
    "term_shapes",
    """WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, CASE p_partkey % 4 WHEN 0 THEN p_name || '/' || p_type WHEN 1 THEN p_name || '/' || (p_partkey % 9) || '차' WHEN 2 THEN p_brand ELSE 'a/b' END AS slashed FROM part)
SELECT p_partkey, array_to_string(CASE WHEN len(l) >= 2 THEN l ELSE [] END, ',') AS parts,
  CASE WHEN length(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) BETWEEN 2 AND 30 THEN trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END AS phrase,
  p_name AS ko, p_brand || ',' || p_type AS english,
  CASE WHEN length(p_name) BETWEEN 2 AND 20 AND NOT regexp_matches(p_name, '(는가|한가|인가|까|기|법|것|다)$') THEN p_name END AS concept,
  CASE p_partkey % 3 WHEN 0 THEN 'ko' WHEN 1 THEN 'en' ELSE 'ko' END AS iso
FROM (SELECT *, list_filter(list_transform(string_split(slashed, '/'), lambda x: trim(x)), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+차$')) AS l FROM p)""",
)
def term_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slash terms, terms with English in parentheses, phrases, section concepts and language tags of parts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    slashed = F.when(k == 0, F.concat_ws("/", "p_name", "p_type")).when(k == 1, F.concat(F.col("p_name"), F.lit("/"), (F.col("p_partkey") % 9).cast("string"), F.lit("차"))).when(k == 2, F.col("p_brand")).otherwise("a/b")
    bracketed = text.paren_term(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(" , "), F.col("p_type"), F.lit(")")))
    title = F.concat(F.lit("9.2 "), F.col("p_name"), F.lit(": more of it"))
    tag = F.get(F.array(F.lit("ko-KR"), F.lit("EN-us"), F.lit("")), (F.col("p_partkey") % 3).cast("int"))
    return p.select(
        "p_partkey", F.array_join(text.slash_terms(slashed), ",").alias("parts"), text.phrase(F.col("p_name")).alias("phrase"), bracketed["ko"].alias("ko"),
        F.array_join(bracketed["english"], ",").alias("english"), text.section_concept(title).alias("concept"), text.iso639(tag).alias("iso"),
    )


@query(
    "speech_markup",
    """SELECT conv_id, turn, '<speak xml:lang=''' || CASE WHEN turn % 2 = 0 THEN 'en-US' ELSE 'ja-JP' END || '''><prosody rate=''+10%''>' ||
  replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</prosody></speak>' AS ssml,
  concat_ws(chr(10) || chr(10), 'Role: ' || role, CASE WHEN turn > 0 THEN 'Turn ' || turn END, text) AS prompt, conv_id || ':seg-' || turn || ':en' AS key
FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL""",
)
def speech_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup for speech, prompts of optional blocks, and keys that name a spoken segment."""
    c = table(spark, sf_dir, "conversations").where("text is not null and conv_id is not null and turn is not null and role is not null")
    n = F.col("turn").cast("string")
    locale = F.when(F.col("turn") % 2 == 0, "en-US").otherwise("ja-JP")
    return c.select(
        "conv_id", "turn", text.ssml(locale, F.col("text"), 10).alias("ssml"),
        text.prompt(F.concat(F.lit("Role: "), "role"), F.when(F.col("turn") > 0, F.concat(F.lit("Turn "), n)), F.col("text")).alias("prompt"),
        text.dedupe_key(F.col("conv_id").cast("string"), F.concat(F.lit("seg-"), n), F.lit("en")).alias("key"),
    )


@query(
    "failure_kinds",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'card') OR contains(lower(text), 'secret') THEN 'permanent' WHEN contains(lower(text), 'the ') OR contains(lower(text), 'der ') THEN 'transient' ELSE 'retryable' END AS kind FROM documents""",
)
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as messages of failures, by marker words, permanent ones first."""
    kind = text.failure_kind(F.col("text"), ("card", "secret"), ("the ", "der "))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


@query(
    "unit_vectors",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, round(list_inner_product(e, e), 6) AS product, round(sqrt(list_sum(list_transform(e, lambda x: x * x))) / CASE WHEN list_inner_product(e, e) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END, 6) AS norm,
  round(e[1] / CASE WHEN list_inner_product(e, e) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END, 6) AS first FROM v""",
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products, and unit vectors (a zero vector stays zero)."""
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding", vectors.l2_normalised("embedding").alias("u"))
    return v.select("vec_id", F.round(vectors.inner_product("embedding", "embedding"), 6).alias("product"), F.round(F.sqrt(vectors.inner_product("u", "u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query(
    "clamped_scores",
    """SELECT event_id, greatest(0.0, least(1.0, value / 200)) AS clamped, CAST(round_even(CAST(event_id % 1000 AS DECIMAL(18, 5)) / 8, 1) AS DOUBLE) AS half_even FROM events""",
)
def clamped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values clamped to a range, and numbers rounded half to even."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 200)).alias("clamped"), F.bround((F.col("event_id") % 1000).cast("decimal(18,5)") / 8, 1).cast("double").alias("half_even"))


@query(
    "resampled_sound",
    """WITH s AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(round(x * 1000) AS INT)) AS a FROM embeddings WHERE len(embedding) >= 8),
r AS (SELECT vec_id, a, list_transform(range(0, 12), lambda i: i * (16000.0::DOUBLE / 24000)) AS places FROM s)
SELECT vec_id, array_to_string(list_transform(places, lambda p: CAST(round(a[CAST(floor(p) AS INT) + 1] + (coalesce(a[CAST(floor(p) AS INT) + 2], a[CAST(floor(p) AS INT) + 1]) - a[CAST(floor(p) AS INT) + 1]) * (p - floor(p))) AS INT)), ',') AS samples,
  CAST(floor(floor(2 * (vec_id % 900) / 2) * 1000 / 16000) AS BIGINT) AS ms, CAST(ceil(2 * (vec_id % 900) / 320.0) * 320 AS BIGINT) AS padded FROM r""",
)
def resampled_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples from 16 to 24 kHz by linear interpolation; durations, and lengths filled up to frames."""
    s = table(spark, sf_dir, "embeddings").where("size(embedding) >= 8")
    # the product stays a 32-bit float: a wider one lies beside some of the halves that it is rounded to
    samples = F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("float") * F.lit(1000).cast("float")).cast("int"))
    pcm = F.encode(F.repeat(F.lit("x"), (2 * (F.col("vec_id") % 900)).cast("int")), "UTF-8")
    return s.select("vec_id", F.array_join(audio.resampled(samples), ",").alias("samples"), audio.duration_ms(pcm).alias("ms"), F.length(audio.padded(pcm)).cast("long").alias("padded"))


@query(
    "parsed_locales",
    """SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN coalesce(text, '') ELSE '' END AS en, CASE WHEN turn % 3 = 0 THEN coalesce(role, '') ELSE '' END AS ja,
  CASE WHEN role IN ('user', 'assistant') THEN role END AS status, CASE WHEN turn % 2 = 0 THEN coalesce(role, 'base') ELSE 'base' END AS voice, 'x' AS rate FROM conversations WHERE turn IS NOT NULL""",
)
def parsed_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON objects of locales (every third is bare text), status in JSON or bare, configuration laid over defaults."""
    c = table(spark, sf_dir, "conversations").where("turn is not null")
    both = F.to_json(F.struct(F.col("text").alias("en-US"), F.col("role").alias("ja-JP")))
    raw = F.when(F.col("turn") % 3 == 0, both).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.col("text").alias("en-US")))).otherwise(F.col("text"))
    status = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("role").alias("status")))).otherwise(F.col("role"))
    base = F.create_map(F.lit("voice"), F.lit("base"), F.lit("rate"), F.lit("x"))
    own = maps.overlaid(base, F.create_map(F.lit("voice"), F.when(F.col("turn") % 2 == 0, F.col("role"))))
    en, ja = maps.parsed_locales(raw, ["en-US", "ja-JP"])
    return c.select("conv_id", "turn", en.alias("en"), ja.alias("ja"), maps.worker_status(status, ("user", "assistant")).alias("status"), own["voice"].alias("voice"), own["rate"].alias("rate"))


@query(
    "cancellation_details",
    """SELECT event_id, CASE WHEN value > 50 THEN event_type WHEN value > 10 THEN props END AS details, CASE WHEN value > 50 THEN NULL WHEN value > 10 THEN CAST(user_id AS VARCHAR) END AS code
FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL""",
)
def cancellation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details and code of a cancelled result: those of the first of two places that has details."""
    e = table(spark, sf_dir, "events").where("event_type is not null and props is not null")
    one = F.struct(F.when(F.col("value") > 50, F.col("event_type")).alias("details"), F.lit(None).cast("string").alias("code"))
    two = F.struct(F.when(F.col("value") > 10, F.col("props")).alias("details"), F.col("user_id").cast("string").alias("code"))
    got = maps.cancellation(one, two)
    return e.select("event_id", got["details"].alias("details"), got["code"].alias("code"))


@query(
    "locale_guards",
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['en-US', 'ja-JP'] WHEN 1 THEN ['xx-XX', 'en-US'] WHEN 2 THEN ['de-DE'] ELSE [] END AS l FROM customer)
SELECT c_custkey, list_contains(l, 'en-US') AS wants_english, CASE c_custkey % 4 WHEN 0 THEN 'en-US,ja-JP' END AS voiced, c_custkey % 4 IN (0, 2) AS accepted FROM c""",
)
def locale_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of a locale, locales with a voice (one unsupported rejects all), and valid session settings."""
    sets = {0: ["en-US", "ja-JP"], 1: ["xx-XX", "en-US"], 2: ["de-DE"]}
    k = F.col("c_custkey") % 4
    none = F.array().cast("array<string>")
    locales = F.coalesce(*[F.when(k == n, F.array(*[F.lit(x) for x in v])) for n, v in sets.items()], none)
    c = table(spark, sf_dir, "customer").select("c_custkey", locales.alias("target_locales"), F.lit("active").alias("status"), F.col("c_custkey").alias("session_id"))
    supported = ("en-US", "ja-JP", "de-DE")
    live = readers.session_configs(c.select("session_id", "status"), c.select("session_id", "target_locales"), supported).select(F.col("session_id").alias("_s"))
    out = c.join(live, c.c_custkey == live["_s"], "left")
    return out.select("c_custkey", F.array_contains("target_locales", "en-US").alias("wants_english"), F.array_join(readers.voiced_locales(F.col("target_locales"), supported, ("en-US", "ja-JP")), ",").alias("voiced"), F.col("_s").isNotNull().alias("accepted"))


@query(
    "pdf_materials",
    """WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN 'application/pdf' ELSE 'text/html' END END AS mime,
  CASE WHEN page_id % 3 = 1 THEN regexp_extract(url, '[^/?#]*$') || CASE WHEN page_id % 2 = 0 THEN '.PDF' ELSE '.pdf.txt' END END AS name, replace(url, '.html', CASE WHEN page_id % 2 = 0 THEN '.Pdf' ELSE '.html' END) AS u FROM pages)
SELECT page_id, CASE WHEN mime IS NOT NULL THEN mime = 'application/pdf' WHEN name IS NOT NULL THEN ends_with(lower(regexp_replace(name, '[?#].*$', '')), '.pdf')
  ELSE coalesce(ends_with(lower(regexp_replace(u, '[?#].*$', '')), '.pdf'), false) END AS is_pdf FROM p""",
)
def pdf_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF by type, else by file name, else by the path of the URL."""
    k, even = F.col("page_id") % 3, F.col("page_id") % 2 == 0
    mime = F.when(k == 0, F.when(even, "application/pdf").otherwise("text/html"))
    name = F.when(k == 1, F.concat(F.regexp_extract("url", "[^/?#]*$", 0), F.when(even, ".PDF").otherwise(".pdf.txt")))
    url = F.replace("url", F.lit(".html"), F.when(even, ".Pdf").otherwise(".html"))
    return table(spark, sf_dir, "pages").select("page_id", readers.is_pdf(mime, name, url).alias("is_pdf"))


@query(
    "recogniser_events",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE round((event_id % 100) / 100.0, 2)::DOUBLE END AS confidence, event_id * 7 // 10000 AS offset_ms, event_id % 50000 // 10000 AS duration_ms,
  ['delta', 'completed', 'failed', 'other'][event_id % 4 + 1] AS kind FROM events""",
)
def recogniser_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and events of speech recognition in JSON."""
    n = F.col("event_id")
    best = F.when(n % 4 == 3, "[]").otherwise(F.concat(F.lit('[{"Confidence":'), ((n % 100) / 100).cast("string"), F.lit("},{}]")))
    value = F.concat(F.lit('{"NBest":'), best, F.lit(',"DisplayText":"'), n.cast("string"), F.lit('","Offset":'), (n * 7).cast("string"), F.lit(',"Duration":'), (n % 50000).cast("string"), F.lit("}"))
    kinds = ["transcription.delta", "transcription.completed", "transcription.failed", "session.created"]
    event = F.concat(F.lit('{"item_id":"'), n.cast("string"), F.lit('","type":"'), _picked(n, kinds), F.lit('"}'))
    e = table(spark, sf_dir, "events").where("event_id is not null")
    results = readers.recogniser_results(e.select(value.alias("value"))).select(F.col("text").cast("long").alias("event_id"), "confidence", "offset_ms", "duration_ms")
    kinds_of = readers.realtime_events(e.select(event.alias("value"))).select(F.col("item_id").cast("long").alias("event_id"), "kind")
    return results.join(kinds_of, "event_id")


@query(
    "accepted_messages",
    """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type <> 'error' AND value >= 20 AND json_extract_string(props, '$.k') IS NOT NULL""",
)
def accepted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are JSON objects with all required members; some come cut short, some without their members."""
    whole = F.to_json(F.struct("event_id", "user_id", F.from_json("props", "k bigint")["k"].alias("k")))
    value = F.when(F.col("event_type") == "error", F.col("props")).when(F.col("value") >= 20, whole).otherwise(F.left(whole, F.length(whole) - 3))
    events = table(spark, sf_dir, "events").where("event_type is not null")
    return jobs.valid_events(events.select(value.alias("value")), "event_id bigint, user_id bigint, k bigint", ["event_id", "user_id", "k"])


@query(
    "glossary_terms",
    """WITH l AS (SELECT id, string_agg(coalesce(p_name, CAST(rel AS VARCHAR)), ', ' ORDER BY k) AS related
  FROM (SELECT p_partkey AS id, unnest([p_partkey + 1, p_partkey * 2]) AS rel, unnest([1, 2]) AS k FROM part) LEFT JOIN part ON p_partkey = rel GROUP BY id)
SELECT 'term_' || id AS chunk_id, concat_ws(chr(10), 'term: ' || p_name, CASE WHEN p_size > 25 THEN 'english: ' || p_type END, 'definition: ' || p_brand, 'related: ' || related) AS text
FROM part JOIN l ON p_partkey = id""",
)
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each part as a glossary term, with its related terms by name (unknown ones by number)."""
    key = F.col("p_partkey")
    terms = table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"), F.col("p_name").alias("ko"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("en"),
        F.col("p_brand").alias("definition"), F.array((key + 1).cast("string"), (key * 2).cast("string")).alias("related"),
    )
    return chunking.glossary_chunks(terms)


@query(
    "key_term_chunks",
    """WITH c AS (SELECT p_partkey // 8 AS ch, p_partkey % 8 < 3 AS t, printf('b_ch%02d', p_partkey // 8) || CASE WHEN p_partkey % 8 < 3 THEN '_terms_' ELSE '_s' END || p_partkey AS chunk_id, p_name AS text FROM part),
k AS (SELECT s_suppkey AS ch, unnest([s_name, 'n' || s_nationkey]) AS term, unnest(['d1', 'd2']) AS said, unnest([1, 2]) AS i FROM supplier WHERE s_nationkey % 3 <> 2)
SELECT chunk_id, text FROM c WHERE NOT (t AND ch IN (SELECT ch FROM k))
UNION ALL SELECT printf('b_ch%02d_term%02d', ch, i), term || ': ' || said FROM k WHERE ch IN (SELECT ch FROM c WHERE t)""",
)
def key_term_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first terms chunk of a chapter gives way to one chunk for each key term; its siblings go."""
    key = F.col("p_partkey")
    kind = F.when(key % 8 < 3, "_terms_").otherwise("_s")
    chunks = table(spark, sf_dir, "part").select(F.concat(F.format_string("b_ch%02d", F.floor(key / 8)), kind, key.cast("string")).alias("chunk_id"), F.col("p_name").alias("text"))
    term = lambda t, d: F.struct(t.alias("term"), F.lit(d).alias("desc"))
    chapters = table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 2")
    chapters = chapters.select(F.col("s_suppkey").alias("chapter_no"), F.array(term(F.col("s_name"), "d1"), term(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "d2")).alias("key_terms"))
    return chunking.split_key_terms(chunks, chapters)


@query(
    "slide_chunks",
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, page_no, trim(line) AS body FROM p WHERE regexp_matches(line, '[\\p{L}\\p{N}]')),
s AS (SELECT doc_id, count(*) FILTER (length(body) >= 50) AS n_slides, count(*) AS n_lines, count(*) FILTER (page_no % 2 = 1) AS n_weeks FROM d GROUP BY doc_id)
SELECT * FROM s WHERE n_slides > 0 UNION ALL SELECT doc_id, 0, count(*), -1 FROM p WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE n_slides > 0) GROUP BY doc_id""",
)
def slide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as slides of a deck and of marked weeks; short ones are no chunk; sources without slides fall back."""
    pages = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    pages = pages.select("doc_id", (F.col("p") + 1).alias("page_no"), "line")
    deck = chunking.deck_slides(pages.withColumn("text", F.concat(F.lit("Title\n"), "line")), "doc_id").where("body <> ''")
    weeks = chunking.lecture_slides(pages.withColumn("text", F.concat(F.when(F.col("page_no") % 2 == 1, "Week 3\n").otherwise("Notes\n"), "line")), "doc_id")
    shown = deck.groupBy("doc_id").agg(F.count_if(F.length("body") >= chunking.MIN_SLIDE_CHARS).alias("n_slides"), F.count(F.lit(1)).alias("n_lines"))
    marked = weeks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_weeks"))
    found = shown.join(marked, "doc_id", "left").na.fill(0, ["n_weeks"])
    whole = pages.groupBy("doc_id").agg(F.lit(0).cast("long").alias("n_slides"), F.count("*").alias("n_lines"), F.lit(-1).cast("long").alias("n_weeks"))
    return chunking.with_fallback(found.where("n_slides > 0"), whole, "doc_id")


@query(
    "hit_payloads",
    """WITH c AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '' END AS section, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS chapter FROM part WHERE p_size > 5)
SELECT l_orderkey, l_linenumber, coalesce(nullif(section, ''), nullif(chapter, ''), '') AS section_title, round_even(l_discount / 7, 4) AS score FROM lineitem LEFT JOIN c ON l_partkey = p_partkey""",
)
def hit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their chunk's section title: its section, else its chapter, else nothing; a hit without a chunk has none."""
    k = F.col("p_size")
    chunks = table(spark, sf_dir, "part").where(k > 5).select(
        "p_partkey", F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "").alias("section_title"), F.when(k % 2 == 0, F.col("p_type")).otherwise("").alias("chapter")
    )
    hits = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") / 7).alias("score"))
    found = hits.join(chunks, F.col("l_partkey") == F.col("p_partkey"), "left")
    return chunking.hit_payload(found).select("l_orderkey", "l_linenumber", "section_title", "score")


@query(
    "glossary_hits",
    """WITH t AS (SELECT * FROM (VALUES (0, 'the'), (1, 'er'), (2, 'ü'), (3, 'zzzz')) v(ord, term))
SELECT b.item_id AS sentence_id, array_to_string(list_concat(coalesce((SELECT list(term ORDER BY ord) FROM t WHERE contains(b.text, t.term)), []), ['extra']), ',') AS hits FROM benchmark b WHERE b.text IS NOT NULL""",
)
def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary terms in a sentence in the order of the glossary, then further ones."""
    s = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("sentence_id"), F.col("text").alias("sentence"))
    terms = spark.createDataFrame([(0, "the"), (1, "er"), (2, "ü"), (3, "zzzz")], "ord int, term string")
    return lexicon.glossary_hits(s, terms, F.array(F.lit("extra"))).withColumn("hits", F.array_join("hits", ","))


@query(
    "united_lexicon",
    """WITH u AS (SELECT 0 AS s, p_partkey AS ord, p_name || ' ' || p_brand AS pattern, 'GLOSSARY_TERM' AS reason FROM part WHERE p_size > 30 UNION ALL SELECT 1, p_partkey, upper(p_name || ' ' || p_brand), 'TEXTBOOK' FROM part WHERE p_size <= 40
  UNION ALL SELECT 2, s_suppkey, s_name, 'SUPPLEMENT' FROM supplier UNION ALL SELECT 2, s_suppkey + 1000000000, lower(s_name), 'SUPPLEMENT' FROM supplier)
SELECT pattern, reason, ord FROM (SELECT *, row_number() OVER (PARTITION BY lower(pattern) ORDER BY s, ord) AS n FROM u) WHERE n = 1""",
)
def united_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon sources in one: of equal patterns the first source's stays, and its first in order."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    one = lambda rows, ord_, pattern, reason: rows.select(ord_.alias("ord"), pattern.alias("pattern"), F.lit(reason).alias("reason"))
    key, name, named = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_brand"), F.col("s_suppkey")
    more = one(s, named, F.col("s_name"), "SUPPLEMENT").unionByName(one(s, named + 1_000_000_000, F.lower("s_name"), "SUPPLEMENT"))
    return lexicon.united(one(p.where("p_size > 30"), key, name, "GLOSSARY_TERM"), one(p.where("p_size <= 40"), key, F.upper(name), "TEXTBOOK"), more).select("pattern", "reason", "ord")


@query(
    "deleted_parents",
    """SELECT c_custkey, CASE WHEN n.n_regionkey = 1 THEN NULL ELSE c_nationkey END AS unlinked, n.n_regionkey <> 1 AS stays_in_cascade FROM customer JOIN nation n ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0""",
)
def deleted_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after some were deleted, and after the nations of one region were: unlinked, or gone with them."""
    c = table(spark, sf_dir, "customer")
    c = relational.deleted(c, c.where("c_custkey % 10 = 0").select("c_custkey"), "c_custkey")
    n = table(spark, sf_dir, "nation")
    c = c.join(n.select(F.col("n_nationkey").alias("_k")), F.col("c_nationkey") == F.col("_k")).drop("_k")
    gone = n.where("n_regionkey = 1")
    stays = relational.cascaded(c, "c_nationkey", gone, "n_nationkey", "cascade").select(F.col("c_custkey").alias("_c"))
    unlinked = relational.cascaded(c, "c_nationkey", gone, "n_nationkey", "set null")
    out = unlinked.join(stays, unlinked.c_custkey == stays["_c"], "left")
    return out.select("c_custkey", F.col("c_nationkey").alias("unlinked"), F.col("_c").isNotNull().alias("stays_in_cascade"))


@query(
    "bulk_updates",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'failed' WHEN page_id % 4 = 1 THEN 'ready' ELSE 'pending' END AS status,
  CASE WHEN url LIKE '%/1%' THEN 'pdf' ELSE 'other' END AS kind, page_id % 4 = 0 AS affected FROM pages""",
)
def bulk_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional bulk updates: stuck rows fail; a column is filled by a pattern, then the rest by a default."""
    k = F.col("page_id") % 4
    status = F.when(k == 0, "indexing").when(k == 1, "ready").otherwise("pending")
    p = table(spark, sf_dir, "pages").select("page_id", "url", status.alias("status"), F.lit(None).cast("string").alias("kind"))
    p = relational.updated_where(p, F.col("kind").isNull() & F.col("url").like("%/1%"), {"kind": F.lit("pdf")}).drop("affected")
    p = relational.updated_where(p, F.col("kind").isNull(), {"kind": F.lit("other")}).drop("affected")
    return relational.updated_where(p, F.col("status") == "indexing", {"status": F.lit("failed")}).select("page_id", "status", "kind", "affected")


@query(
    "latest_worker_status",
    """SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1 AND ts > TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 86400 SECONDS""",
)
def latest_worker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest status of each worker that has not expired."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"), "event_id")
    e = e.withColumn("_order", F.struct("ts", "event_id"))
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    newest = e.groupBy("user_id").agg(F.max_by(F.struct("ts", "status"), "_order").alias("s")).select("user_id", "s.*")
    return writers.latest_status(newest, "user_id", "ts", now, 86_400).select("user_id", "status")


@query(
    "shown_captions",
    """SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 = 1""",
)
def shown_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of the wanted topics in one locale; others are not shown."""
    e = table(spark, sf_dir, "events").withColumn("locale", F.when(F.col("user_id") % 3 == 1, "en-US").otherwise("ja-JP"))
    return relational.optional_filters(e, locale="en-US").where(relational.whitelisted(F.col("event_type"), ("click", "view")).isNotNull()).select("event_id")


@query(
    "admitted_tracks",
    """SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#') AND c_custkey % 2 = 0""",
)
def admitted_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound tracks of participants whose name has the speaker's prefix."""
    c = table(spark, sf_dir, "customer").withColumn("kind", F.when(F.col("c_custkey") % 2 == 0, "audio").otherwise("video"))
    return relational.optional_filters(c, kind="audio").where(F.col("c_name").startswith("Customer#")).select("c_custkey")


@query(
    "draft_partials",
    """SELECT conv_id, turn, trim(text) AS draft FROM conversations WHERE length(trim(text)) >= 6 AND trim(text) <> 'listening'""",
)
def draft_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results that are worth a draft: six characters at least, and not the placeholder."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.draft(F.col("text"), "listening").alias("draft")).where("draft is not null")


@query(
    "running_deltas",
    """SELECT conv_id, turn, string_agg(role, '' ORDER BY turn) FILTER (turn % 4 <> 3) OVER w AS heard FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
WINDOW w AS (PARTITION BY conv_id, turn // 4 ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
def running_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running text of an item's deltas."""
    from chalkline.operators import ordered

    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", "role").distinct()
    c = c.withColumns({"item": F.floor(F.col("turn") / 4), "delta": F.when(F.col("turn") % 4 != 3, F.col("role"))})
    return ordered.running_text(c, ["conv_id", "item"], "turn", "delta", "heard").select("conv_id", "turn", "heard")


@query(
    "upload_defaults",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'own' ELSE 'upload' END AS doc_type, CASE WHEN page_id % 2 = 0 THEN page_id ELSE -1 END AS week FROM pages""",
)
def upload_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of an uploaded file get the material's metadata where they have none."""
    p = table(spark, sf_dir, "pages")
    chunks = p.select("page_id", F.when(F.col("page_id") % 3 == 0, "own").alias("doc_type"), F.when(F.col("page_id") % 2 == 0, F.col("page_id")).alias("week"))
    return chunking.with_defaults(chunks, {"doc_type": F.lit("upload"), "week": F.lit(-1).cast("long")})
