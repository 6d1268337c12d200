"""A log of committed batches in a store that all executors share.

A batch's rows go to a folder of their own first; only then one row that names the folder is appended to the
log. A write that dies leaves a folder that no log row names, so readers see a batch whole or not at all. A
batch that is in the log already is not written again (unless ``replace``), so retries count once. ``compact``
folds the batches into one folder, named by a log row that stands for all before it.

Defined results: an empty log reads as no rows; batch names may have any characters, since they are data and
never part of a path; an empty batch is committed like any other. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.session import ensure_checkpoint_dir

_LOG = "number bigint, batches array<string>, folder string, whole boolean"


class CommitLog:
    """Batches under ``path``, all of the columns in ``schema`` (DDL)."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        spark.createDataFrame([], _LOG).coalesce(1).write.mode("ignore").parquet(f"{self.path}/log")

    @classmethod
    def fresh(cls, spark: SparkSession, name: str, schema: str) -> CommitLog:
        """An empty log in the cluster's shared folder."""
        return cls(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", schema)

    def _live(self) -> list:
        """Log rows that count, in order: one for each batch since the last compaction, and that."""
        rows = sorted(self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect(), key=lambda r: r.number)
        start = max([k for k, r in enumerate(rows) if r.whole], default=0)
        last = {tuple(r.batches): r for r in rows[start:]}
        return sorted(last.values(), key=lambda r: r.number)

    def _append(self, live: list, batches: list[str], folder: str, whole: bool) -> None:
        number = max([r.number for r in live], default=0) + 1
        self.spark.createDataFrame([(number, batches, folder, whole)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def batches(self) -> set[str]:
        return {b for r in self._live() for b in r.batches}

    def commit(self, batch: str, rows: Callable[[], DataFrame], replace: bool = False) -> bool:
        """Writes what ``rows`` gives as ``batch``; false, and nothing is worked out, if it is there already.

        With ``replace`` a batch that is there, and not compacted yet, is exchanged for the new rows.
        """
        live = self._live()
        if any(batch in r.batches for r in live):
            if not replace:
                return False
            if any(batch in r.batches and r.whole for r in live):
                raise ValueError("a batch that was compacted cannot be replaced")
        folder = f"{self.path}/rows-{uuid.uuid4().hex}"
        rows().write.parquet(folder)
        self._append(live, [batch], folder, False)
        return True

    def read(self) -> DataFrame:
        """The rows of all batches that count."""
        folders = [r.folder for r in self._live()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def compact(self, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """One folder with ``fold`` of all rows takes the place of the batches' folders."""
        live = self._live()
        if len(live) > 1:
            folder = f"{self.path}/rows-{uuid.uuid4().hex}"
            fold(self.read()).write.parquet(folder)
            self._append(live, sorted({b for r in live for b in r.batches}), folder, True)


def none_of(schema: str) -> F.Column:
    """An empty array of structs of ``schema``."""
    return F.array().cast(f"array<struct<{schema}>>")
