"""Versions of a stored table by compare-and-set, and an index whose partitions are replaced atomically.

A version is a small JSON file that names the data folders that count. Writers put their rows into folders of their
own first, then write the next version's file under another name and rename it, which fails if that version exists:
of two writers that began at one version one succeeds. (The rename is the one Spark's own commit logs use: atomic on
HDFS; on a store without atomic renames one writer at a time is assumed.) Readers hold a version: what is written
meanwhile does not change it, until ``clean`` takes away old versions and folders that none of the rest names.

A version's file has an entry for each partition and commit, never rows; the driver reads that and nothing else.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Versions:
    """The versions under ``path``, 0 (nothing) being always there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(n) for n in (re.fullmatch(r"(\d{12})\.json", x) for x in self._names("versions")) if n for n in [n[1]]]

    def latest(self) -> int:
        return max(self.numbers(), default=0)

    def content(self, version: int) -> dict:
        if not version:
            return {}
        stream = self._fs.open(self._at(f"versions/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> int:
        """Makes ``content`` the version after ``version``; a ``Conflict`` if there is one already."""
        made, last = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version + 1:012d}.json")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(last.toUri(), self._conf)
        rename = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            context.rename(made, last, how)
        except Exception as e:
            self._fs.delete(made, False)
            if self._fs.exists(last):
                raise Conflict(f"version {version + 1} is there already") from e
            raise
        return version + 1

    def clean(self, keep: int, folders_of) -> int:
        """Removes all but the newest ``keep`` versions and the folders under data/ that none of these names. Number of folders removed."""
        numbers = self.numbers()
        live = {f for n in numbers[-keep:] for f in folders_of(self.content(n))}
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"versions/{n:012d}.json"), False)
        gone = [d for d in self._names("data") if d not in live]
        for d in gone:
            self._fs.delete(self._at(f"data/{d}"), True)
        return len(gone)


class VersionedIndex:
    """Rows by ``by``, whose values are replaced or appended to; each change is one version, whole or not at all.

    Defined results: a value that new rows do not have keeps its rows; rows with a null ``by`` are a partition of
    their own; an index without versions reads as no rows of ``schema``; writes of no rows make a version like others.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, schema: StructType) -> None:
        self.spark, self.by, self.schema, self.versions = spark, by, schema, Versions(spark, path)

    def _written(self, rows: DataFrame) -> tuple[str, list[str]]:
        """The rows' folder and the partitions in it."""
        folder = f"commit={uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.partitionBy(self.by).parquet(f"{self.versions.path}/data/{folder}")
        return folder, [d for d in self.versions._names(f"data/{folder}") if d.startswith(f"{self.by}=")]

    def _change(self, rows: DataFrame, replace: bool, expect: int | None, tries: int) -> int:
        folder, changed = self._written(rows)
        while True:
            version = self.versions.latest()
            if expect is not None and version != expect:
                raise Conflict(f"the index is at version {version}, not {expect}")
            held = self.versions.content(version).get("partitions", {})
            held = {**held, **{p: ([] if replace else held.get(p, [])) + [folder] for p in changed}}
            try:
                return self.versions.commit(version, {"partitions": held})
            except Conflict:
                tries -= 1
                if expect is not None or tries <= 0:
                    raise

    def replace(self, rows: DataFrame, expect: int | None = None, tries: int = 5) -> int:
        """The partitions that ``rows`` has are exchanged for them. ``expect``: only if this is still the version."""
        return self._change(rows, True, expect, tries)

    def append(self, rows: DataFrame, expect: int | None = None, tries: int = 5) -> int:
        return self._change(rows, False, expect, tries)

    def append_new(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows whose ``keys`` the index does not have yet; begins anew if another writer came first, so none is there twice."""
        while True:
            version = self.versions.latest()
            fresh = rows.dropDuplicates(keys).join(self.read(version).select(*keys), keys, "left_anti")
            try:
                return self.append(fresh, expect=version)
            except Conflict:
                continue

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest); a filter on ``by`` reads its folders only."""
        held = self.versions.content(self.versions.latest() if version is None else version).get("partitions", {})
        paths = [f"{self.versions.path}/data/{folder}/{p}" for p, folders in held.items() for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        stored = StructType([*self.schema.fields, StructField("commit", StringType())])
        found = self.spark.read.schema(stored).option("basePath", f"{self.versions.path}/data").parquet(*paths)
        return found.select(*self.schema.names)

    def clean(self, keep: int = 2) -> int:
        return self.versions.clean(keep, lambda content: {f for folders in content.get("partitions", {}).values() for f in folders})
