"""Versioned index and log-structured upserts: conflicts, snapshots, replays, writes that die, bounded runs."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.sources.snapshots import Conflict, VersionedIndex, Versions
from chalkline.streaming.upserts import Upserts

ROW = "course_id string, chunk_id string, text string"


def index_of(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema
    return VersionedIndex(spark, str(tmp_path / "index"), "course_id", schema), lambda *rows: spark.createDataFrame(list(rows), schema)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_of_two_writers_succeeds(spark, tmp_path):
    a, b = (Versions(spark, str(tmp_path / "v")) for _ in range(2))
    assert a.latest() == 0 and a.content(0) == {}
    assert a.commit(0, {"by": "a"}) == 1
    with pytest.raises(Conflict):
        b.commit(0, {"by": "b"})
    assert b.content(1) == {"by": "a"} and b.commit(1, {"by": "b"}) == 2 and a.numbers() == [1, 2]


def test_partitions_are_replaced_and_snapshots_stay(spark, tmp_path):
    index, rows = index_of(spark, tmp_path)
    assert held(index.read()) == []
    v1 = index.replace(rows(("a", "1", "x"), ("a", "2", "y"), ("b/ c", "3", "z"), (None, "4", "w")))
    snapshot = index.read()
    v2 = index.replace(rows(("a", "9", "new")))
    v3 = index.append(rows(("a", "10", "more"), ("c", "11", None)))
    assert (v1, v2, v3) == (1, 2, 3)
    assert held(snapshot) == held(index.read(1)) == held(rows(("a", "1", "x"), ("a", "2", "y"), ("b/ c", "3", "z"), (None, "4", "w")))
    assert held(index.read()) == held(rows(("a", "9", "new"), ("a", "10", "more"), ("b/ c", "3", "z"), ("c", "11", None), (None, "4", "w")))
    assert held(index.read().where("course_id = 'a'")) == [("a", "10", "more"), ("a", "9", "new")]
    assert "PartitionFilters: [isnotnull(course_id" in index.read().where("course_id = 'a'")._jdf.queryExecution().toString()
    with pytest.raises(Conflict):
        index.replace(rows(("a", "0", "late")), expect=1)
    assert index.append_new(rows(("a", "9", "again"), ("d", "12", "q"), ("d", "12", "q")), ["course_id", "chunk_id"]) == 4
    assert [r.chunk_id for r in index.read().where("course_id = 'd'").collect()] == ["12"]
    assert index.clean(keep=1) == 1  # the folder of the write that lost; those of versions 1 and 2 are still in use in part
    assert index.versions.numbers() == [4] and index.read().count() == 6
    assert index.replace(rows()) == 5 and index.read().count() == 6


def test_unnamed_folders_are_not_read(spark, tmp_path):
    index, rows = index_of(spark, tmp_path)
    index.replace(rows(("a", "1", "x")))
    index._written(rows(("a", "2", "of a write that died")))
    assert held(index.read()) == [("a", "1", "x")] and index.clean() == 1


EVENT = "k long, n long, v string"


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng, want = random.Random(5), {}
    table = Upserts(spark, str(tmp_path / "t"), spark.createDataFrame([], EVENT).schema, ["k"], ["n"], fan=3, buckets=2)
    assert table.read().count() == 0
    for number in range(14):
        rows = [(rng.choice([None, *range(12)]), i, f"{number}-{i}") for i in range(rng.randrange(8))]
        for k, n, v in rows:
            want[k] = (k, n, v)
        batch = spark.createDataFrame(rows, EVENT)
        assert table.merge(batch, number) and not table.merge(batch, number)
        assert table.n_runs() <= 2 * 3
    assert held(table.read()) == sorted(want.values(), key=repr)
    some = spark.createDataFrame([(1,), (5,), (99,)], "k long")
    assert held(table.lookup(some)) == sorted((want[k] for k in (1, 5) if k in want), key=repr)
    assert table.clean(keep=1) > 0 and held(table.read()) == sorted(want.values(), key=repr)


def test_runs_stay_few(spark, tmp_path, monkeypatch):
    """A thousand batches: the folders to read are a few for each level (the files are left out here)."""
    table = Upserts(spark, str(tmp_path / "t"), spark.createDataFrame([], EVENT).schema, ["k"], ["n"], fan=8)
    state = {"version": 0, "content": {"done": -1, "runs": []}}
    monkeypatch.setattr(table, "_write", lambda rows: "run")
    monkeypatch.setattr(table, "_runs", lambda folders: one)
    monkeypatch.setattr(table, "_state", lambda: (state["version"], state["content"]))
    monkeypatch.setattr(table.versions, "commit", lambda version, content: state.update(version=version + 1, content=content) or version + 1)
    one = spark.createDataFrame([(1, 1, "x", 0, 0)], f"{EVENT}, _batch long, _bucket int").cache()
    monkeypatch.setattr(type(one), "isEmpty", lambda self: False)
    most = 0
    for number in range(1000):
        assert table.merge(one, number)
        most = max(most, len(state["content"]["runs"]))
    assert most <= 7 * 4 and state["content"]["done"] == 999


def test_upserts_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, k, f"a{k}"), (k + 10, 0, "b")], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = Upserts(spark, str(tmp_path / "t"), spark.createDataFrame([], EVENT).schema, ["k"], ["n"])
    for _ in range(2):  # the second start finds nothing new
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert table.start(events, str(tmp_path / "check")).awaitTermination(120)
    got = {r.k: r.v for r in table.read().collect()}
    assert got.keys() == {1, 10, 11, 12} and got[1].startswith("a")


def test_updates_change_only_known_rows(spark, tmp_path):
    rng = random.Random(8)
    table = Upserts(spark, str(tmp_path / "t"), spark.createDataFrame([], EVENT + ", w string").schema, ["k"], ["n"], fan=3, buckets=2)
    want = {k: (k, 0, "old", f"w{k}") for k in [None, *range(6)]}
    table.merge(spark.createDataFrame([*want.values()], EVENT + ", w string"), 0)
    for number in range(1, 6):
        rows = [(rng.choice([None, *range(9)]), 100 * number + i, rng.choice([None, f"{number}-{i}"])) for i in range(8)]
        for k in {r[0] for r in rows} & set(range(6)):
            _, n, v = max((r for r in rows if r[0] == k), key=lambda r: r[1])
            want[k] = (k, n, want[k][2] if v is None else v, want[k][3])
        batch = spark.createDataFrame(rows, EVENT)
        assert table.update(batch, number) and not table.update(batch, number)
    assert held(table.read()) == sorted(want.values(), key=repr)
    assert table.update(spark.createDataFrame([], EVENT), 6) and held(table.read()) == sorted(want.values(), key=repr)


def test_updates_of_a_stream(spark, tmp_path):
    table = Upserts(spark, str(tmp_path / "t"), spark.createDataFrame([], EVENT).schema, ["k"], ["n"])
    table.merge(spark.createDataFrame([(1, 0, "a"), (2, 0, "a")], EVENT), 0)
    spark.createDataFrame([(1, 1, "b"), (3, 1, "b")], EVENT).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        events = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        assert table.start(events, str(tmp_path / "check"), only_known=True, first=1).awaitTermination(120)
    assert held(table.read()) == [(1, 1, "b"), (2, 0, "a")]


def test_versions_hold_no_rows(spark, tmp_path):
    index, rows = index_of(spark, tmp_path)
    index.replace(rows(*[("a", str(k), "x") for k in range(500)]))
    assert len(str(index.versions.content(1))) < 200 and index.read().select(F.countDistinct("chunk_id")).first()[0] == 500
