"""Sequence numbers that go on after a restart: the last number of each session is state, and can be read back.

A new query (with a checkpoint of its own) starts from the numbers that an earlier one left: ``last_numbers`` reads
them with the state data source, and ``numbered_stream`` takes them as its initial state. State of a session that has
been silent for ``ttl_hours`` goes (None: never; with a time to live a query does not end of itself).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chalkline.streaming.fold import with_rocksdb

NUMBERED = "session_id string, ord bigint, sequence bigint, segment_id string, text string"
_STATE = "last"


class _Numbers(StatefulProcessor):
    def __init__(self, run: str, ttl_ms: int | None) -> None:
        self.run, self.ttl = run, ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState(_STATE, "sequence long", ttlDurationMs=self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((initialState["sequence"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.last.get()[0] if self.last.exists() else 0
        for row in sorted(rows, key=lambda r: r["ord"]):
            n += 1
            yield Row(session_id=key[0], ord=row["ord"], sequence=n, segment_id=f"{key[0]}-{self.run}-seg-{n:06d}", text=row["text"])
        self.last.update((n,))

    def close(self) -> None:
        pass


def numbered_stream(segments: DataFrame, run: str, start: DataFrame | None = None, ttl_hours: int | None = 24) -> DataFrame:
    """``segments`` (session_id, ord, text) with the next numbers of their session, after those in ``start`` (session_id,
    sequence). Segments without session are left out."""
    with_rocksdb(segments.sparkSession)
    keyed = segments.where("session_id is not null").select(F.col("session_id").cast("string"), F.col("ord").cast("long"), "text").groupBy("session_id")
    first = start.select(F.col("session_id").cast("string"), F.col("sequence").cast("long")).groupBy("session_id") if start is not None else None
    numbers = _Numbers(run, ttl_hours and ttl_hours * 3600 * 1000)
    return keyed.transformWithState(numbers, NUMBERED, "append", "ProcessingTime" if ttl_hours else "None", initialState=first)


def last_numbers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, sequence) that a query of ``numbered_stream`` left in its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", _STATE).load(checkpoint)
    value = F.col("value.value") if "value" in state.select("value.*").columns else F.col("value")
    return state.select(F.col("key.session_id").alias("session_id"), value["sequence"].alias("sequence"))
