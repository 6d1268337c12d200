"""Jobs fanned out to lanes, one for each session and locale, each worked off one job after the other.

A job is for a list of locales. In each lane jobs are taken in order of arrival, the next one when the last is done.
A job that has waited over ``most_wait_ms`` while a newer one is queued is skipped and takes no time (0: none is). An end
drains its session's lanes: what is not done ``flush_ms`` after it is discarded, also the job in work, and jobs that
come until then are refused; later ones open the lane anew. Times are whole milliseconds of event time.

What happens between rows is worked out from the clock of the next row, in a stream also by an event-time timer, so
results do not depend on the micro-batches. A lane's results are given in order, each when it is settled.

Defined results: a locale that is not supported is refused for its job alone; a locale named twice counts once; a null
or negative duration is 0; of equal times rows come in the order of ``ord``, and a job is taken after all rows of its
time; rows without session or time, and jobs without locales, are left out; an end is for all supported locales. In a
batch a lane ends after its last job, in a stream it goes on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.streaming.fold import Keeper, walked, with_rocksdb

DONE = "lane string, ord bigint, status string, queued_ms bigint, started_ms bigint, ended_ms bigint"
STATE = "ords array<bigint>, ats array<bigint>, takes array<bigint>, free bigint, work array<bigint>, refused bigint"
_FIELDS = ["kind", "ord", "ms", "takes_ms"]


@dataclass(frozen=True)
class Lanes:
    locales: tuple[str, ...]
    most_wait_ms: int = 3000
    flush_ms: int = 3000


class Lane:
    """Jobs that wait, the one in work (ord, queued, started, ended), since when the lane is free, until when it refuses."""

    def __init__(self, ords=(), ats=(), takes=(), free=None, work=None, refused=None, *, rules: Lanes) -> None:
        self.waiting = deque(zip(ords, ats, takes))
        self.free, self.work, self.refused, self.rules = free, tuple(work) if work else None, refused, rules

    def state(self) -> tuple:
        ords, ats, takes = (list(c) for c in zip(*self.waiting)) if self.waiting else ([], [], [])
        return ords, ats, takes, self.free, list(self.work) if self.work else None, self.refused

    def _next(self) -> int | None:
        """When the job in work is done, else when the first that waits is taken."""
        if self.work:
            return self.work[3]
        return max(self.waiting[0][1], self.free or 0) if self.waiting else None

    def due(self) -> int | None:
        at = self._next()
        return None if at is None else at + 1

    def advance(self, to: float) -> Iterator[tuple]:
        """All that is settled before ``to``."""
        while (at := self._next()) is not None and at < to:
            if self.work:
                ord_, queued, started, ended = self.work
                yield ord_, "played", queued, started, ended
                self.free, self.work = ended, None
                continue
            ord_, queued, takes = self.waiting.popleft()
            stale = 0 < self.rules.most_wait_ms < at - queued
            if stale and self.waiting and self.waiting[0][1] <= at:
                yield ord_, "skipped", queued, None, None
                self.free = at
            else:
                self.work = (ord_, queued, at, at + takes)

    def row(self, kind: str, ord_: int, at: int, takes: int) -> Iterator[tuple]:
        yield from self.advance(at)
        if kind == "end":
            yield from self._drained(at)
        elif self.refused is not None and at < self.refused:
            yield ord_, "refused", at, None, None
        else:
            self.waiting.append((ord_, at, takes))

    def _drained(self, at: int) -> Iterator[tuple]:
        deadline, last = at + self.rules.flush_ms, at
        for made in self.advance(deadline + 1):
            last = max(last, made[4] or at)
            yield made
        if self.work or self.waiting:
            last = deadline
            if self.work:
                yield self.work[0], "discarded", self.work[1], self.work[2], None
            yield from ((ord_, "discarded", queued, None, None) for ord_, queued, _ in self.waiting)
            self.waiting.clear()
        self.work, self.free, self.refused = None, last, max(last, self.refused or last)

    def end(self) -> Iterator[tuple]:
        yield from self.advance(inf)


def _fanned(jobs: DataFrame, rules: Lanes) -> DataFrame:
    """A row for each lane of a job, and for each lane of a session that ends."""
    known = jobs.where("session_id is not null and at is not null")
    every = F.array(*[F.lit(x) for x in rules.locales])
    locales = F.when(F.col("kind") == "end", every).otherwise(F.array_distinct(F.array_compact("locales")))
    at = F.col("at").cast("timestamp")
    return known.select(
        F.col("session_id").cast("string").alias("session_id"), F.explode(locales).alias("locale"), F.coalesce("kind", F.lit("job")).alias("kind"), F.col("ord").cast("long").alias("ord"),
        at.alias("at"), F.unix_millis(at).alias("ms"), F.greatest(F.coalesce(F.col("takes_ms").cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("takes_ms"),
    )


def _named(done: DataFrame) -> DataFrame:
    lane = F.from_json("lane", "array<string>")
    return done.select(lane[0].alias("session_id"), lane[1].alias("locale"), *done.columns[1:])


def _split(jobs: DataFrame, rules: Lanes) -> tuple[DataFrame, DataFrame]:
    """Rows of lanes, and the refusals of locales that have none."""
    fanned = _fanned(jobs, rules)
    none = F.lit(None).cast("long")
    supported = F.col("locale").isin(*rules.locales)
    refused = fanned.where(~supported).select("session_id", "locale", "ord", F.lit("unsupported").alias("status"), F.col("ms").alias("queued_ms"), none.alias("started_ms"), none.alias("ended_ms"))
    return fanned.where(supported).withColumn("lane", F.to_json(F.array("session_id", "locale"))), refused


def worked_off(jobs: DataFrame, rules: Lanes) -> DataFrame:
    """(session_id, locale, ord, status, queued_ms, started_ms, ended_ms) of each job in each of its locales.

    ``jobs``: (session_id, ord, kind job or end, locales, at, takes_ms). Status is played, skipped, discarded, refused
    or unsupported.
    """
    rows, refused = _split(jobs, rules)
    return _named(walked(rows, "lane", ["ms", "ord"], _FIELDS, lambda: Lane(rules=rules), DONE)).unionByName(refused)


def worked_off_stream(jobs: DataFrame, rules: Lanes, delay: str = "1 second") -> DataFrame:
    """The same over a stream whose sessions come in order; the watermark fires the timers. The refusals of unsupported
    locales need no state."""
    with_rocksdb(jobs.sparkSession)
    rows, refused = _split(jobs.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay), rules)
    start = lambda *state: Lane(*state, rules=rules)
    keeper = Keeper(start, _FIELDS, ["ms", "ord"], STATE, ["lane", "ord", "status", "queued_ms", "started_ms", "ended_ms"], timers=True)
    done = rows.groupBy("lane").transformWithState(keeper, DONE, "append", "EventTime")
    return _named(done).unionByName(refused)
