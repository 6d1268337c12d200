"""Upserts of a stream as a log-structured table: runs by level, merged when a level has too many.

A micro-batch adds a run with the last row of each of its keys. When a level has ``fan`` runs they are merged into
one of the next level, so after n batches there are at most (fan - 1) x log(n) runs, and a row is rewritten once a
level. All runs are dealt into the same ``buckets`` by key: a look-up of few keys reads their buckets only, and a
merge works bucket by bucket. Versions are set as in ``sources.snapshots``; the number of the last batch is part of a
version, so a batch that runs again changes nothing, and a write that dies leaves a folder that no version names.

Defined results: of a key's rows the one of the highest batch counts, in a batch the last by ``arrival``; null keys
are a key; an empty batch makes a version without a run; a table without batches reads as no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chalkline.operators.relational import last_wins
from chalkline.sources.snapshots import Versions

_BATCH, _BUCKET = "_batch", "_bucket"


class Upserts:
    """The table under ``path``; one writing query at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], arrival: list[str], fan: int = 8, buckets: int = 8) -> None:
        self.spark, self.schema, self.keys, self.arrival, self.fan, self.buckets = spark, schema, keys, arrival, fan, buckets
        self.versions = Versions(spark, path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> str:
        folder = f"run={uuid.uuid4().hex}"
        self._bucketed(rows).repartition(self.buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.versions.path}/data/{folder}")
        return folder

    def _runs(self, folders: list[str]) -> DataFrame:
        stored = StructType([*self.schema.fields]).add(_BATCH, "long").add(_BUCKET, "integer")
        if not folders:
            return self.spark.createDataFrame([], stored)
        paths = [f"{self.versions.path}/data/{f}" for f in folders]
        return self.spark.read.schema(stored.add("run", "string")).option("basePath", f"{self.versions.path}/data").parquet(*paths).drop("run")

    def _state(self) -> tuple[int, dict]:
        version = self.versions.latest()
        return version, self.versions.content(version) or {"done": -1, "runs": []}

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Adds micro-batch ``number``; false if it is in the table already."""
        version, state = self._state()
        if number <= state["done"]:
            return False
        new = last_wins(batch.select(*self.schema.names), self.keys, self.arrival).withColumn(_BATCH, F.lit(number).cast("long"))
        runs = list(state["runs"])
        if not batch.isEmpty():
            runs.append([0, self._write(new)])
        version = self.versions.commit(version, {"done": number, "runs": runs})
        self._compact(version, number, runs)
        return True

    def update(self, changes: DataFrame, number: int) -> bool:
        """Micro-batch ``number`` of changes (keys, arrival and some columns) to rows that are there.

        Of a key's changes the last by arrival counts; a null leaves the column as it is. Keys that the table lacks,
        and null keys, change nothing. False if the batch is in the table already.
        """
        if number <= self._state()[1]["done"]:
            return False
        names = [c for c in self.schema.names if c in changes.columns and c not in self.keys]
        last = last_wins(changes.select(*self.keys, *names), self.keys, self.arrival)
        last = last.select(*self.keys, *[F.col(c).alias(f"_new_{c}") for c in names])
        held = self.lookup(last).join(last, self.keys)
        return self.merge(held.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in self.schema.names]), number)

    def _compact(self, version: int, number: int, runs: list) -> None:
        level = 0
        while (full := [f for at, f in runs if at == level]) and len(full) >= self.fan:
            merged = self._write(last_wins(self._runs(full), self.keys, [_BATCH]).drop(_BUCKET))
            runs = [r for r in runs if r[0] != level] + [[level + 1, merged]]
            version = self.versions.commit(version, {"done": number, "runs": runs})
            level += 1

    def read(self, version: int | None = None) -> DataFrame:
        """The last row of each key."""
        content = self.versions.content(self.versions.latest() if version is None else version)
        found = self._runs([f for _, f in content.get("runs", [])])
        return last_wins(found, self.keys, [_BATCH]).select(*self.schema.names)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the keys in ``wanted`` (a few): other buckets are not read."""
        some = self._bucketed(wanted.select(*self.keys)).distinct()
        buckets = [r[0] for r in some.select(_BUCKET).distinct().collect()]  # at most the number of buckets
        content = self.versions.content(self.versions.latest())
        found = self._runs([f for _, f in content.get("runs", [])]).where(F.col(_BUCKET).isin(buckets))
        return last_wins(found.join(some.select(*self.keys), self.keys, "left_semi"), self.keys, [_BATCH]).select(*self.schema.names)

    def n_runs(self) -> int:
        return len(self._state()[1]["runs"])

    def clean(self, keep: int = 2) -> int:
        return self.versions.clean(keep, lambda content: {f for _, f in content.get("runs", [])})

    def start(self, events: DataFrame, checkpoint: str, only_known: bool = False, first: int = 0, **trigger) -> StreamingQuery:
        """Keeps the table up to date with a stream of rows, or (``only_known``) of changes to the rows that are there.

        ``first``: number of the stream's first batch, above those merged before it.
        """
        take = self.update if only_known else self.merge
        handle = lambda batch, number: take(batch, number + first)
        return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
