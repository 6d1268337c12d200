"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed rows, is summed by group and is
committed through a log: its rows are whole before the log names them, and a batch that is in the log is
not worked out again, so a retried batch counts once. Totals are the sums of all committed batches;
``compact`` folds them into one.

Defined results: a null text has no tokens but is a document; null sources and languages are groups of
their own; repeated rows count as often as they occur; empty batches commit nothing that counts; before
any commit the totals are empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.commits import CommitLog

GROUP = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, tokenizer: str, version: str, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of each document."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chalkline.llm.tokens import give_back, word_ids

        coder = word_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = coder.counts([t or "" for t in part.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n)], ["doc_id", "source", "lang", "n_tokens"])
        give_back()

    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text).cast("string"))
    counted_docs = plain.mapInArrow(counted, "doc_id long, source string, lang string, n_tokens long")
    return counted_docs.withColumn("tokenizer", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that take the old counts out and put the new ones in."""
    return deletes(before).unionByName(inserts(after))


def estimated(docs: DataFrame, version: str, characters: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) with a guess of one token for so many characters."""
    guess = F.ceil(F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))) / characters).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), guess.alias("n_tokens"), F.lit(version).alias("tokenizer"))


class Rollup:
    """Totals kept as signed deltas in a commit log."""

    def __init__(self, log: CommitLog) -> None:
        self.log = log

    @classmethod
    def fresh(cls, spark: SparkSession) -> Rollup:
        """An empty rollup in the cluster's shared folder."""
        return cls(CommitLog.fresh(spark, "rollup", _DELTA))

    def commit(self, batch: str, signed: DataFrame | Callable[[], DataFrame], replace: bool = False) -> bool:
        """Adds a batch of signed rows; false if it was there (``replace``: then it takes the old one's place)."""
        return self.log.commit(batch, lambda: _summed(signed() if callable(signed) else signed), replace)

    def compact(self) -> None:
        self.log.compact(_summed)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all batches; groups without documents are gone."""
        return _summed(self.log.read()).where("n_docs <> 0 or n_tokens <> 0")


def _summed(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
