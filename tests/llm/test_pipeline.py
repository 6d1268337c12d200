import corpus_pipeline
from chalkline.llm import decontaminate, jaccard, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, docs)
        assert k == 4 or docs.columns == columns
    before, after = seen["quality"]
    assert after.count() == quality.judge(before).where("kept").count()
    before, after = seen["near_duplicates"]
    labels = jaccard.jaccard_join(before).toPandas()
    assert sorted(r.doc_id for r in after.collect()) == sorted(labels.class_id.unique())
    before, after = seen["decontamination"]
    bad = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet"), ["doc_id"]).collect()}
    assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = seen["pii"]
    text = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == pii.redacted(text[r.doc_id]) and r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    keys = ["doc_id", "start", "length", "ids_crc32"]
    run = sorted(map(tuple, corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"length": "sum"}).collect()))
    assert run == sorted(map(tuple, after.groupBy("doc_id").agg({"length": "sum"}).collect())) and set(keys) <= set(after.columns)
