"""Streams of jobs and captions: deduplication with two lifetimes, late drop, throttle, work queues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chalkline.sources.snapshots import VersionedIndex

DONE_SECONDS, FAILED_SECONDS = 3600, 30


def _acquire(live_until: float | None, at: float) -> bool:
    return live_until is None or live_until <= at


def acquisitions(attempts: DataFrame, done_seconds: float = DONE_SECONDS, failed_seconds: float = FAILED_SECONDS) -> DataFrame:
    """(key, ord, at, acquired) of each attempt: only without a live entry of any state.

    ``attempts``: (key, ord, at in seconds, outcome): a finished attempt blocks for ``done_seconds``, a
    failed one for ``failed_seconds`` (0: not at all).
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, until = None, None
        for batch in batches:
            keys, ats, outcomes = (batch.column(k).to_pylist() for k in (0, 2, 3))
            got = []
            for key, at, outcome in zip(keys, ats, outcomes):
                if key != current:
                    current, until = key, None
                ok = _acquire(until, at)
                if ok:
                    until = at + (failed_seconds if outcome == "failed" else done_seconds)
                got.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.bool_())], ["key", "ord", "at", "acquired"])

    plain = attempts.select(F.col("key").cast("string"), F.col("ord").cast("long"), F.col("at").cast("double"), F.col("outcome").cast("string"))
    in_order = plain.repartition("key").sortWithinPartitions("key", "at", "ord")
    return in_order.mapInArrow(walked, "key string, ord long, at double, acquired boolean")


def acquisitions_stream(attempts: DataFrame, done_seconds: float = DONE_SECONDS, failed_seconds: float = FAILED_SECONDS) -> DataFrame:
    """The same over a stream; a key's state leaves when its entry is no longer live."""

    def step(key, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        until = group.get[0] if group.exists else None
        rows = sorted((r for f in frames for r in f.itertuples()), key=lambda r: (r.at, r.ord))
        out = []
        for r in rows:
            ok = _acquire(until, r.at)
            if ok:
                until = r.at + (failed_seconds if r.outcome == "failed" else done_seconds)
            out.append((key[0], r.ord, r.at, ok))
        group.update((until,))
        group.setTimeoutDuration(int(1000 * max(done_seconds, 1)))
        yield pd.DataFrame(out, columns=["key", "ord", "at", "acquired"])

    return attempts.groupBy("key").applyInPandasWithState(step, "key string, ord long, at double, acquired boolean", "until double", "append", "ProcessingTimeTimeout")


def once(jobs: DataFrame, keys: list[str], at: str, lateness: str = "1 hour") -> DataFrame:
    """First job of each key within the lateness, for streams whose jobs never fail."""
    return jobs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def late_dropped_stream(packets: DataFrame, forget_seconds: int = 6 * 3600) -> DataFrame:
    """Packets (key, ord, sequence, text) whose sequence exceeds all seen before in their session.

    A session's state leaves after ``forget_seconds`` without packets.
    """

    def step(key, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        seen = group.get[0] if group.exists else 0
        out = []
        for r in sorted((r for f in frames for r in f.itertuples()), key=lambda r: r.ord):
            if r.sequence > seen:
                seen = r.sequence
                out.append((key[0], r.ord, r.sequence, r.text))
        group.update((int(seen),))
        group.setTimeoutDuration(1000 * forget_seconds)
        yield pd.DataFrame(out, columns=["key", "ord", "sequence", "text"])

    return packets.groupBy("key").applyInPandasWithState(step, "key string, ord long, sequence long, text string", "seen long", "append", "ProcessingTimeTimeout")


def throttled(partials: DataFrame, keys: list[str], at: str, seconds: int = 1, lateness: str = "10 seconds") -> DataFrame:
    """The newest partial of each key in each window of time; works on batches and streams."""
    stamped = partials.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return stamped.groupBy(*keys, F.window(at, f"{seconds} seconds").alias("slot")).agg(F.max_by("text", at).alias("text"))


def idle_sessions(finals: DataFrame, gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Session windows: results less than ``gap`` apart belong together."""
    stamped = finals.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    return stamped.groupBy("session_id", F.session_window("at", gap).alias("span")).agg(F.count(F.lit(1)).alias("n"))


def valid_events(raw: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Objects of JSON lines (column value) with all required members; others are dropped, also those that text follows."""
    alone = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{schema}>>")
    out = raw.select(alone.alias("e")).where("size(e) = 1").select(F.get("e", F.lit(0)).alias("e")).where("e is not null").select("e.*")
    for c in required:
        out = out.where(F.col(c).isNotNull())
    return out


def index_queue(jobs: DataFrame, chunks_of, index: VersionedIndex, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Indexing jobs at least once: each batch's chunks that are not indexed yet are appended as one version.

    ``chunks_of``: batch of jobs -> rows of the index. The query's checkpoint is the list of jobs in work; a batch
    that runs again finds its chunks present.
    """
    handle = lambda batch, number: index.append_new(chunks_of(batch), keys)
    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
