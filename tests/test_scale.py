"""Plans for large inputs give the rows of those for small ones: ranges, cells, automata; with their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.operators import automaton, evaluation, latency, ordered, report, retrieval, selection


@pytest.mark.parametrize("buckets", [64, 4096])
def test_percentiles_by_ranges_equal_sorting(spark, monkeypatch, buckets):
    rng = random.Random(3)
    of = {
        "even": [float(k) for k in range(3000)], "tie": [7.0] * 900, "few": [1.0, 2.0], "one": [5.5], "scales": [10.0**k for k in range(-300, 300, 3)] + [1e-320, -1e308, 1e308],
        "noise": [rng.gauss(0, 1) for _ in range(2000)] + [3.0] * 500, None: [1.0, 4.0, 9.0],
    }
    rows = [(s, v) for s, values in of.items() for v in values] + [("even", None), ("even", float("nan")), ("nothing", float("inf"))]
    df = spark.createDataFrame(rows, "stage string, v double").repartition(5)
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    monkeypatch.setattr(selection, "SORTED_VALUES", 2)
    wanted = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r.stage: r.q for r in selection.quantiles(df, "stage", "v", wanted).collect()}
    assert got.keys() == {k for k in of if k is not None}
    for stage, q in got.items():
        exact = [float(np.sort(of[stage])[int(np.floor(p * (len(of[stage]) - 1)))]) for p in wanted]
        high = [float(np.sort(of[stage])[int(np.ceil(p * (len(of[stage]) - 1)))]) for p in wanted]
        assert all(a <= x <= b for a, x, b in zip(exact, q, high))
        if stage != "scales":
            assert q == pytest.approx(np.quantile(of[stage], wanted).tolist(), rel=1e-12, abs=1e-12)


def test_percentiles_keep_listed_stages(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED_VALUES", 3)
    df = spark.createDataFrame([("a", float(k)) for k in range(11)] + [("b", 1.0), ("b", 2.0), ("c", None)], "stage string, ms double")
    stages = spark.createDataFrame([("a",), ("a",), ("z",)], "stage string")
    got = {r.stage: (r.n, r.status, r.p50, r.p95) for r in latency.percentiles(df, "stage", "ms", stages).collect()}
    assert got == {"a": (11, "ok", 5.0, 9.5), "b": (2, "skipped", None, None), "z": (0, "not measured", None, None)}


def test_speech_end(spark):
    df = spark.createDataFrame([(10.0, 1500, 500), (None, 1, 1), (1.0, None, 1), (1.0, 1, None)], "a double, o long, d long")
    assert [r[0] for r in df.select(latency.speech_end(F.col("a"), F.col("o"), F.col("d"))).collect()] == [12.0, None, None, None]


def test_top_k_in_cells_equals_scan(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [(k, f"i{k % 3}", rng.normal(size=8).round(3).tolist()) for k in range(400)] + [(900, "i0", [0.0] * 8), (901, None, [1.0] * 8), (None, "i0", [1.0] * 8), (902, "i1", None)]
    vectors += [(1000 + k, "tie", [1.0] + [0.0] * 7) for k in range(9)]
    queries = [(k, rng.normal(size=8).round(3).tolist()) for k in range(37)] + [(77, [0.0] * 8), (None, [1.0] * 8)]
    v, q = spark.createDataFrame(vectors, "chunk_id long, index_name string, embedding array<float>"), spark.createDataFrame(queries, "query_id long, embedding array<float>")
    found = lambda: sorted((tuple(r) for r in retrieval.top_k_per_index(v, q, 4).collect()), key=repr)
    want = found()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    monkeypatch.setattr(retrieval, "CELL", 50)
    monkeypatch.setattr(retrieval, "SCORES", 64)
    assert found() == want and len({r[0] for r in want}) == 38
    assert retrieval.top_k_per_index(v.limit(0), q, 4).count() == 0
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4096)
    assert retrieval.top_k_per_index(v, q.limit(0), 4).count() == 0


@pytest.mark.parametrize(("part", "slot"), [(10**6, 10**6), (7, 5)])
def test_automata_find_what_contains_finds(spark, monkeypatch, part, slot):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abÄé ") for _ in range(rng.randrange(n)))
    patterns = [(k, word(5)) for k in range(60)] + [(100, ""), (101, None), (102, "AB"), (103, "ab"), (104, "ab")]
    texts = [(k, word(30)) for k in range(80)] + [(200, None), (201, ""), (202, "xABx" * 5000)]
    lex, said = spark.createDataFrame(patterns, "ord long, pattern string"), spark.createDataFrame(texts, "sentence_id long, sentence string")
    monkeypatch.setattr(automaton, "PART_PATTERNS", part)
    monkeypatch.setattr(automaton, "SLOT_SENTENCES", slot)
    monkeypatch.setattr(automaton, "PAIRS", 3)
    got = sorted((r.sentence_id, r.ord) for r in automaton.contained(said, lex, "sentence", "pattern").collect())
    assert got == sorted((i, k) for i, t in texts for k, p in patterns if t is not None and p is not None and p.lower() in t.lower())
    assert automaton.contained(said.limit(0), lex, "sentence", "pattern").count() == 0 and automaton.contained(said, lex.limit(0), "sentence", "pattern").count() == 0


def test_many_patterns(spark):
    lex = spark.range(300_000).select(F.col("id").alias("ord"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x")).alias("pattern"))
    said = spark.range(500).select(F.col("id").alias("sentence_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * 600 + k).cast("string"), F.lit("x")) for k in (0, 7, 599)]).alias("sentence"))
    met = automaton.contained(said, lex, "sentence", "pattern")
    assert met.where("ord < sentence_id * 600 or ord >= sentence_id * 600 + 600").count() == 0 and met.count() == 1500


def test_running_and_whole_text(spark):
    rows = [("a", k, None if k < 2 else f"{k},", "x") for k in range(500)] + [("b", 1, None, "y"), (None, 1, "n", "z")]
    df = spark.createDataFrame(rows, "item string, k long, delta string, other string").repartition(3)
    got = {(r.item, r.k): r.heard for r in ordered.running_text(df, ["item"], "k", "delta", "heard").collect()}
    assert got["a", 499] == "".join(f"{k}," for k in range(2, 500)) and got["a", 1] is None and got["a", 3] == "2,3," and got["b", 1] is None and got[None, 1] == "n"
    whole = {r.item: r.t for r in ordered.whole_text(df, ["item"], "k", "delta", "t").collect()}
    assert whole == {"a": got["a", 499], "b": None, None: "n"}


def test_failed_runs_are_empty(spark):
    samples = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "k int, reference string")
    runs = spark.createDataFrame([(1, "a b"), (2, None)], "k int, hypothesis string")
    assert sorted(map(tuple, evaluation.scored_runs(samples, runs, "k").collect())) == [(1, "a b", "a b"), (2, "c", ""), (3, "", "")]


def test_report(spark):
    df = spark.createDataFrame([("a|b", 1234.56), (None, None)], "k string, v double")
    lines = lambda rows: [r.line for r in report.markdown_table(rows, "T", [F.col("k").desc()], {"k": report.cell(F.col("k")), "v": report.cell(F.col("v"), 1)}).orderBy("line_no").collect()]
    assert lines(df) == ["## T", "", "| k | v |", "|---|---|", "| a\\|b | 1,234.6 |", "| - | - |"]
    assert lines(df.limit(0)) == ["## T", "", "nothing measured"]
