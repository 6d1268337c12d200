import time

import pytest
from pyspark.sql import functions as F

from chalkline.sources import snapshots
from chalkline.streaming import jobs, segmenter


def run(df, name, mode="append"):
    """Rows of a stream over what is there. A query with timers never ends of itself: it is stopped once these had time to fire."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    began, fed = time.monotonic(), None
    while q.isActive and time.monotonic() - began < 120:
        rows = [p["numInputRows"] for p in q.recentProgress]
        fed = fed or (time.monotonic() if any(rows) else None)
        if fed and rows[-1] == 0 and time.monotonic() - fed > 4:
            break
        time.sleep(0.2)
    if q.exception():
        raise q.exception()
    q.stop()
    return df.sparkSession.table(name).collect()


@pytest.fixture
def finals(spark, tmp_path):
    rows = [("s1", 1, "Hello there. More", 0.9, 0.0), ("s1", 2, "words come!", 0.5, 0.4), ("s2", 1, "Only one.", None, 0.0), ("s2", 2, "Then two.", 0.7, 9.0)]
    df = spark.createDataFrame(rows, "session_id string, ord long, text string, confidence double, at double")
    df.coalesce(1).write.parquet(str(tmp_path / "finals"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "finals"))


def test_stream_equals_batch(finals):
    batch, stream = finals
    want = sorted((r.session_id, r.sequence, r.text, r.confidence) for r in segmenter.segments(batch).collect())
    got = sorted((r.session_id, r.sequence, r.text, r.confidence) for r in run(segmenter.segments_stream(stream), "segs"))
    assert want == got == [("s1", 1, "Hello there.", 0.9), ("s1", 2, "More words come!", 0.5), ("s2", 1, "Only one.", None), ("s2", 2, "Then two.", 0.7)]


def test_session_end_and_hot_session(spark, tmp_path):
    """A row that ends its session gives the rest; and a long session equals the fold over its results."""
    rows = [("s", 1, "open end", 0.5, 0.0, False), ("s", 2, None, None, 0.2, True), ("t", 1, "no end.", 0.4, 0.0, False)]
    df = spark.createDataFrame(rows, "session_id string, ord long, text string, confidence double, at double, ended boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "ended"))
    got = run(segmenter.segments_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ended"))), "ended")
    assert sorted((r.session_id, r.text) for r in got) == [("s", "open end"), ("t", "no end.")]
    long = [(None if i % 3 else "hot", i, f"word {i}" + "." * (i % 4 == 0), 0.9, i / 2) for i in range(3000)]
    df = spark.createDataFrame(long, "session_id string, ord long, text string, confidence double, at double")
    want = []
    for name in (None, "hot"):
        speech, rules = segmenter.Speech(), segmenter.Rules()
        mine = [r for r in long if r[0] == name]
        want += [(name, *s) for r in mine for s in speech.hear(*r[2:], rules)] + [(name, *s) for s in speech.close(mine[-1][4], rules)]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, segmenter.segments(df).collect()), key=key) == sorted(want, key=key)


def test_acquisitions(spark, tmp_path):
    rows = [("k", i, 0.0, "done") for i in range(10)] + [("f", 1, 0.0, "failed"), ("f", 2, 10.0, "done"), ("f", 3, 31.0, "done")]
    df = spark.createDataFrame(rows, "key string, ord long, at double, outcome string")
    got = jobs.acquisitions(df).where("acquired").collect()
    assert sorted((r.key, r.ord) for r in got) == [("f", 1), ("f", 3), ("k", 0)]
    again = jobs.acquisitions(df, failed_seconds=0).where("acquired").collect()
    assert sorted((r.key, r.ord) for r in again) == [("f", 1), ("f", 2), ("k", 0)]
    df.coalesce(1).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "a"))
    assert sorted((r.key, r.ord) for r in run(jobs.acquisitions_stream(stream), "acq") if r.acquired) == [("f", 1), ("f", 3), ("k", 0)]


def test_queue_indexes_each_chunk_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n long, v string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    chunks = lambda b: b.select(F.col("k").alias("course_id"), F.col("v").alias("chunk_id"), F.col("v").alias("text"))
    index = snapshots.VersionedIndex(spark, str(tmp_path / "idx"), "course_id", chunks(df).schema)
    for c in ("c2", "c3"):  # the second run finds all chunks present
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        assert jobs.index_queue(stream, chunks, index, ["course_id", "chunk_id"], str(tmp_path / c)).awaitTermination(120)
    assert sorted(map(tuple, index.read().collect())) == [("a", "x", "x"), ("a", "y", "y"), ("b", "z", "z")]


def test_windows_and_late_drop(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 1, "a", 0), ("s", 2, 3, "b", 1), ("s", 3, 2, "c", 2), ("s", 4, 4, "d", 60)], "key string, ord long, sequence long, text string, sec long")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "p"))
    assert [r.text for r in run(jobs.late_dropped_stream(stream.drop("sec")), "late")] == ["a", "b", "d"]
    timed = df.withColumn("at", F.timestamp_seconds("sec"))
    assert jobs.throttled(timed, ["key"], "at").count() == 4
    assert jobs.idle_sessions(timed.withColumnRenamed("key", "session_id")).count() == 2
    assert jobs.once(timed, ["key"], "at").isStreaming is False


def test_valid_events(spark):
    raw = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("nope",), ('{"a": 2}',)], "value string")
    assert [tuple(r) for r in jobs.valid_events(raw, "a int, b string", ["a", "b"]).collect()] == [(1, "x")]
