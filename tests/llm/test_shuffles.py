"""What plans for large tables shuffle, against the size of the texts."""

import pytest

from chalkline.llm import decontaminate
from chalkline.session import table

SF = "/root/testdata/sf0.01"


def shuffled(spark) -> int:
    """Bytes written by all shuffles of the session so far."""
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize(("rows", "shingles"), [(0, 0), (10_000, 0)])
def test_decontamination_without_broadcasts(spark, monkeypatch, rows, shingles):
    """All three tables of the benchmark joined by a shuffle; and only the index and the items."""
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    run = lambda: sorted(map(tuple, decontaminate.leaks(docs, bench, ["doc_id"]).collect()))
    want = run()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", shingles)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        assert run() == want and len(want) > 20
        text = docs.selectExpr("sum(octet_length(text)) as n").first()["n"]
        assert shuffled(spark) - before < 6 * text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_repeated_rows_without_broadcasts(spark, monkeypatch):
    """Copies of a row share their place in the tables, and do not multiply."""
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"a {item} b")] * 60 + [(2, f"c {item}"), (None, item), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    got = decontaminate.leaks(docs, bench, ["doc_id"]).collect()
    assert sorted(((r.doc_id, r.word_start, r.similarity) for r in got), key=repr) == [(1, 1, 1.0), (2, 1, 1.0), (None, 0, 1.0)]
    assert sorted(((r.doc_id, r.text) for r in decontaminate.clean(docs, bench).collect()), key=repr) == [(3, None), (4, "")]
