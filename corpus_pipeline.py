"""Corpus pipeline: five of the training-data operators as stages, each over all that its predecessor kept.

1. quality: documents that a rule rejects go.
2. near_duplicates: one document of each group of similar ones stays.
3. decontamination: documents that hold a benchmark item go.
4. pii: personal data is replaced by its kind, and n_chars follows the new text.
5. packing: what is left is packed into sequences of ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import decontaminate, jaccard, packing, pii, quality
from chalkline.llm.paths import tokenizer_path
from chalkline.session import ensure_checkpoint_dir, table

#: Texts that a task hands to Python at once in the last two stages.
BATCH_ROWS = 1500
#: Chunks in the tokenizer's cache: the workers stand beside a JVM that four stages have filled.
CACHED_CHUNKS = 250_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_groups(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _in_small_batches(spark: SparkSession) -> None:
    """From here on whole texts go to Python ``BATCH_ROWS`` at a time: the stages are planned when they are written, so
    the setting of the session has to hold until then."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_ = int(spark.conf.get(name))
    spark.conf.set(name, str(BATCH_ROWS if set_ <= 0 else min(set_, BATCH_ROWS)))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False, max_chunks=CACHED_CHUNKS).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: SQL cannot express tokenisation and packing; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
