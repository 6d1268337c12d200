"""Queries and operators over whole tables, against plain versions."""

import hashlib
import random
import re
import time
import unicodedata

import duckdb

import chalkline.plans  # noqa: F401
from chalkline import registry
from chalkline.operators import lexicon
from chalkline.plans import files
from tests.compare import connection

SF = "/root/testdata/sf0.001"


def saved(spark, tmp_path, table, rows, schema):
    """A folder with one table, as the queries read it."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def plain_phrases(docs):
    first = {}
    for doc_id, text, lang in docs:
        for k, raw in enumerate(text.split(" ") if text is not None else []):
            p = " ".join(raw.split())
            if 2 <= len(p) <= 30:
                row = (doc_id % 3, (doc_id, k + 1), p)
                first[lang, p.lower()] = min(first.get((lang, p.lower()), row), row)
    out = []
    for lang in {lang for lang, _ in first}:
        used = 0
        for n, (priority, (doc_id, k), p) in enumerate(sorted(r for (x, _), r in first.items() if x == lang)):
            used += len(p)
            if n < 50 and used <= 400:
                out.append((lang, priority, doc_id, k, p))
    return sorted(out)


def test_phrase_list_reads_all_documents(spark, tmp_path):
    docs = [(41, "last of all", "en"), (100, "Two words", "en"), (99, "zwei Wörter zwei", "de"), (39, None, "de"), (60, "first two ", "en"), (1, "x" * 45 + " WORDS", "en")]
    docs += [(9, "word" + "\n" * 50 + "word", "it")]
    docs += [(3, "a " * 100_001 + "tail", "fr"), (6, "early", "fr")]  # the numbers of a long text overlap the next one's
    got = registry.QUERIES["phrase_list"](spark, saved(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string"))
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(docs)
    found = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in registry.QUERIES["phrase_list"](spark, SF).collect()) == plain_phrases(found)


def test_phrase_list_moves_few_phrases(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("Wort", "word", "\tx\n\ny", "İ", "ß", "ΑΣ", "a", "", "\U0001f600", "long" * 8) for b in ("", "A", "a", "1", "-2", "É", "é")]
    docs = [(d, " ".join(rng.choices(words[: rng.choice((2, 9, 70))], k=rng.choice((0, 1, 3, 20, 200)))), rng.choice(("de", "en", "fr"))) for d in range(400, 100, -1)]
    docs += [(9, "one two " * 300 + " ".join(f"late{k}" for k in range(90)), "it"), (3, "late7 LATE8 " * 90, "it"), (50, None, "en"), (0, "", "en")]
    docs += [(6 + 3 * k, "Copy of it", "es") for k in range(200)] + [(1206 - 3 * k, f"own{k} copy", "es") for k in range(90)]
    sf = saved(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string")
    d = spark.read.parquet(f"{sf}/documents.parquet").repartition(3).selectExpr("lang", "doc_id % 3 AS priority", "doc_id", "text")
    assert lexicon.leading_phrases(d, ["lang"], "doc_id", 50).count() <= 3 * 5 * 50
    for most in (lexicon.HELD_PHRASES, 20):
        monkeypatch.setattr(lexicon, "HELD_PHRASES", most)
        assert sorted(tuple(r) for r in registry.QUERIES["phrase_list"](spark, sf).collect()) == plain_phrases(docs)


END = re.compile("[.!?。！？…]+[\"'”’)\\]】」』]*\\s*")


def plain_sentences(text):
    parts, at = [], 0
    for m in END.finditer(text):
        parts.append(text[at : m.end()].strip())
        at = m.end()
    return len([p for p in parts if p]), text[at:].strip() == ""


def test_completed_sentences_of_all_texts(spark, tmp_path):
    texts = ["Ja, schön. Über", "Er sagte „nein.” Und", "He said \"no.\" (Yes!)", "終わり。次！「はい。」", "Well… yes…", "one.　", "two.\n", "'", "", None, ".\xa0. rest", "a.) b?] c", "no end\n"]
    sf = saved(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    plain = {i: plain_sentences(t) for i, t in enumerate(texts) if t is not None}
    assert {r.doc_id: (r.n_sentences, r.complete) for r in registry.QUERIES["completed_sentences"](spark, sf).collect()} == plain
    got = {r.doc_id: (r.n_sentences, r.complete) for r in registry.QUERIES["completed_sentences"](spark, SF).collect()}
    assert got == {r.doc_id: plain_sentences(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    checked = connection(SF).sql(registry.ORACLE_SQL["completed_sentences"]).fetchall()  # the plain documents
    assert len(checked) and all(got[i] == (n, complete) for i, n, complete in checked)


def test_completed_sentences_take_time_by_length(spark, tmp_path):
    gap = " " * 150_000  # was tried from each of its blanks to its end
    texts = [f"One{gap}two.{gap}x", f"{gap}One.”{gap}", f"No{gap}end", "。\U0001f600…\uffff？ \x00!"]
    sf = saved(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    begun = time.monotonic()
    got = {r.doc_id: (r.n_sentences, r.complete) for r in registry.QUERIES["completed_sentences"](spark, sf).collect()}
    assert time.monotonic() - begun < 15
    assert got == {i: plain_sentences(t) for i, t in enumerate(texts)}


def test_resampled_sound_rounds_halves_of_floats(spark, tmp_path):
    sound = [0.07629919797182083, -0.27649998664855957, 0.2782303988933563, -0.13032056391239166, 0.09449999779462814, -0.14749999344348907, 0.13349999487400055, -0.08010582625865936]
    sf = saved(spark, tmp_path, "embeddings", [(7, sound), (8, sound[:7]), (9, sound[::-1])], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet/*.parquet'")
    checked = sorted(con.sql(registry.ORACLE_SQL["resampled_sound"]).fetchall())
    assert len(checked) == 2 and checked[0][1].startswith("76,-159,-92,")
    assert sorted(tuple(r) for r in registry.QUERIES["resampled_sound"](spark, sf).collect()) == checked


def files_below(path):
    return [f for f in path.rglob("part-*") if f.is_file()]


def test_page_files_are_few(spark, tmp_path, monkeypatch):
    rows = [(k, turn, f"turn {turn} of {k}") for k in range(300) for turn in range(3)]
    rows += [(900, 0, "a\x00b\x01a\x01\x01b\x00"), (900, 1, "\x00\x00"), (901, 0, ""), (902, 0, "one\ftwo\r\nthree\n"), (902, 1, "\f"), (903, 0, None), (None, 0, "no key")]
    sf = saved(spark, tmp_path, "conversations", rows, "conv_id long, turn long, text string")
    monkeypatch.setattr(files, "_folder", lambda spark, name: str(tmp_path / name))
    plain = {}
    for k, _, text in rows:
        if text is not None:
            plain.setdefault(k, []).append(text)
    wanted = {(k, n, hashlib.sha256(p.encode()).hexdigest()) for k, texts in plain.items() for n, p in enumerate("\f".join(texts).split("\f"), 1)}
    got = [tuple(r) for r in registry.QUERIES["page_files"](spark, sf).collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert len(files_below(tmp_path / "pages")) <= 8


def test_lexicon_files_are_few(spark, tmp_path, monkeypatch):
    rows = [(k, f"name {k % 7} \"x\"\n", k % 5) for k in range(0, 50_000, 20)]
    sf = saved(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_size long")
    monkeypatch.setattr(files, "_folder", lambda spark, name: str(tmp_path / name))
    got = sorted(tuple(r) for r in registry.QUERIES["lexicon_files"](spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{sf}/part.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.ORACLE_SQL["lexicon_files"]).fetchall())
    assert len(files_below(tmp_path / "lexicons")) == 4


def plain_rate(a, b):
    a, b = (re.sub("[\\s.,!?;:\"'“”‘’()\\[\\]{}·…~\\-—啊。！？、，]+", "", unicodedata.normalize("NFC", t).lower()) for t in (a, b))
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return len(a), round(before[-1] / len(a), 6) if a else float(bool(b))


def test_speech_errors_of_all_pairs(spark, tmp_path):
    texts = ["Für „dich“ … ja", "für dich ja", "한국어, 네!", unicodedata.normalize("NFD", "한국어 네"), "one　two\xa0three", "one two tree", "", "…", "x", None, "y"]
    pairs = {i: plain_rate(a, b) for i, (a, b) in enumerate(zip(texts, texts[1:])) if None not in (a, b)}
    sf = saved(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    read = lambda at: {r.item_id: (r.ref_chars, r.cer) for r in registry.QUERIES["speech_errors"](spark, at).collect()}
    assert read(sf) == pairs
    text = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = read(SF)
    assert got == {i: plain_rate(t, text[i + 1]) for i, t in text.items() if i + 1 in text}


def test_large_lexicon_gives_the_same(spark, monkeypatch):
    texts = ["이 말은 한 마디", "The AI said", "a", "ß É x", "", None, "나 b c", "aXXi"]
    sentences = spark.createDataFrame(list(enumerate(texts)), "sentence_id long, sentence string")
    patterns = ["말", "한", "a", "ai", "AI said", "É", "é", "마디", "z", "나 b", "이 말은 한 마디", "a i"]
    rows = [(i, p, p.upper(), "TEXTBOOK", ["xx"] if p == "a i" else None) for i, p in enumerate(patterns)]
    lex = spark.createDataFrame(rows, "ord long, pattern string, canonical string, reason string, exclusions array<string>")
    terms = lex.select("ord", lex.pattern.alias("term"))
    both = lambda: [sorted(map(tuple, df.collect()), key=repr) for df in (lexicon.route(sentences, lex), lexicon.glossary_hits(sentences, terms))]
    small = both()
    assert any("말" in (r[1] or ()) for r in small[1])
    monkeypatch.setattr(lexicon, "BROADCAST_PATTERNS", 3)
    assert both() == small
