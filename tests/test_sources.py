import json

import pytest
from pyspark.sql import functions as F

from chalkline.functions import maps
from chalkline.operators import chunking, ordered, relational, retrieval
from chalkline.sources import readers, writers
from chalkline.streaming import jobs


def test_latency_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"kind": "caption", "sttMs": 5}\n\n{broken\n[1]\n{"kind": "audio", "skipped": true}\n')
    got = readers.latency_records(spark, str(tmp_path / "l.jsonl"))
    assert sorted(r.kind for r in readers.good(got.cache()).collect()) == ["audio", "caption"]
    assert readers.bad_lines(got) == 2


def test_query_sets(spark, tmp_path):
    for name, answers in (("pos", ["c1"]), ("neg", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"query": "q", "answer_chunk_ids": answers, "query_type": "t"}]))
    q = readers.query_sets(spark, [str(tmp_path / "pos.json"), str(tmp_path / "neg.json")])
    assert [r.source for r in readers.positives(q).collect()] == ["pos"]
    assert [r.source for r in readers.negatives(q).collect()] == ["neg"]
    assert readers.first_queries(spark, [str(tmp_path / "pos.json"), str(tmp_path / "neg.json")], 1).first()["answer_chunk_ids"] == ["c1"]


def test_lexicons(spark, tmp_path):
    payload = {"major": "ai", "lexicon": [{"pattern": "p", "canonical": "P", "reason": "R"}], "transliterations": {"a": "b"}, "pattern_exclusions": {"p": ["px"]}}
    (tmp_path / "lexicon_ai.json").write_text(json.dumps(payload))
    (tmp_path / "lexicon_bad.json").write_text("{")
    patterns, pairs = readers.lexicons(spark, str(tmp_path))
    assert [(r.major, r.pattern, r.exclusions) for r in patterns.collect()] == [("ai", "p", ["px"])]
    assert [tuple(r) for r in pairs.collect()] == [("ai", "a", "b")]
    assert "lexicon" in json.loads(writers.exported_lexicon(patterns).first()["value"])


def test_chunks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "s", "d", "text"), ("c2", "s", "d", "more")], "chunk_id string, source string, doc_type string, text string")
    writers.write_chunks(rows, str(tmp_path / "c"))
    assert readers.chunks(spark, str(tmp_path / "c")).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        writers.write_chunks(rows.union(rows), str(tmp_path / "d"))
    assert writers.json_lines(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"] == '{"a":1}'


def test_recogniser_and_glossary(spark):
    raw = spark.createDataFrame([('{"DisplayText":"hi","NBest":[{"Confidence":0.9}],"Offset":20000,"Duration":15999}',)], "value string")
    assert tuple(readers.recogniser_results(raw).first()) == ("hi", 0.9, 2, 1)
    g = spark.createDataFrame([("c", '[{"term":"a","translations":{"en":"A"}},{"term":" "}]'), ("d", "broken")], "course_id string, value string")
    assert [(r.course_id, r.term) for r in readers.glossary(g).collect()] == [("c", "a")]


def test_maps(spark):
    df = spark.createDataFrame([('{"en-US":"x"}',), ("[]",), (None,)], "c string")
    assert [tuple(r) for r in df.select(*maps.parsed_locales(F.col("c"), ["en-US", "ja-JP"])).collect()] == [("x", ""), ("", ""), ("", "")]
    status = spark.createDataFrame([('{"status":"running"}',), ("stopped",), ("odd",)], "raw string").select(maps.worker_status(F.col("raw"), ("running", "stopped")).alias("s"))
    assert [r.s for r in status.collect()] == ["running", "stopped", None]


def test_cascades(spark):
    children = spark.createDataFrame([(1, 10), (2, 20)], "id int, parent int")
    gone = spark.createDataFrame([(10,)], "id int")
    assert [r.id for r in relational.cascaded(children, "parent", gone, "id", "cascade").collect()] == [2]
    assert sorted((r.id, r.parent) for r in relational.cascaded(children, "parent", gone, "id", "set null").collect()) == [(1, None), (2, 20)]
    with pytest.raises(Exception, match="referred"):
        relational.cascaded(children, "parent", gone, "id", "restrict").collect()


def test_slides(spark):
    pages = spark.createDataFrame(
        [("d", 1, "Week3\nIntro\n" + "words " * 20), ("d", 2, "Week3\nIntro\nmore"), ("d", 3, "no mark"), ("d", 4, "Week4\nIntro\nshort")], "doc_id string, page_no int, text string"
    )
    slides = chunking.lecture_slides(pages)
    assert [(r.page_no, r.week) for r in slides.orderBy("page_no").collect()] == [(1, 3), (2, 3), (4, 4)]
    assert [(r["first"], r["last"]) for r in chunking.merged_slides(slides, ["doc_id"]).collect()] == [(1, 2)]


def test_glossary_chunks(spark):
    terms = spark.createDataFrame([("t1", "가", "A", "def", ["t2", "zz"]), ("t2", "나", None, None, [])], "id string, ko string, en string, definition string, related array<string>")
    got = {r.chunk_id: r.text for r in chunking.glossary_chunks(terms).collect()}
    assert got == {"term_t1": "term: 가\nenglish: A\ndefinition: def\nrelated: 나, zz", "term_t2": "term: 나"}


def test_reasons(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "query_id long")
    answers = spark.createDataFrame([(1, True, "ROUTED")], "query_id long, use_rag boolean, reason string")
    got = {r.query_id: r.reason for r in retrieval.with_reasons(ids(1, 2, 3), ids(1, 2), answers).collect()}
    assert got == {1: "ROUTED", 2: "NO_RESULTS", 3: "NO_TRIGGER"}


def test_stale_last_job_plays(spark):
    rows = spark.createDataFrame([("ko", 1, 0.0, 0.0), ("ko", 2, 0.0, 10.0), ("ko", 3, 0.0, 10.0)], "locale string, n int, queued double, started double")
    got = {r.n: r.skipped for r in ordered.stale_skips(rows, ["locale"], "n", "queued", "started").collect()}
    assert got == {1: False, 2: True, 3: False}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ('{"a":1,"b":"x"}', (1, "x")), (' {"a":1,"b":{"k":1}} ', (1, '{"k":1}')), ('{"a":1,"b":"x"', None), ('{"a":1,"b":"x"} more', None), ('{"a":1,"b":"x"}{"a":2,"b":"y"}', None),
        ('{"a":1,"b":"x"},{"a":2,"b":"y"}', None), ('{"a":"no","b":"x"}', None), ('[{"a":1,"b":"x"}]', None), ('{"a":1,"b":"x","c":[1,2', None), ('{"a":1}', None), ("null", None), ("", None), (None, None),
    ],
)
def test_valid_events(spark, value, want):
    got = jobs.valid_events(spark.createDataFrame([(value,)], "value string"), "a bigint, b string", ["a", "b"]).collect()
    assert list(map(tuple, got)) == ([want] if want else [])
