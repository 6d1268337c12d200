"""Conflated requests: one in flight for each session, the newest text waits, a least interval, cancelled by a final.

A partial text replaces the one that waits. A request starts when none is in flight, the interval since the last
start is over, and the waiting text is not the one asked last. A final ends the utterance: what waits is dropped, the
request in flight is cancelled and its answer never shown; the next partial may start at once. Times are whole
milliseconds of event time; ``takes_ms`` is how long a text's request takes.

What happens between rows (an answer, a start after the interval) is worked out from the clock of the next row, in a
stream also by an event-time timer, so results do not depend on the micro-batches. Answers are given in order.

Defined results: texts shorter than ``min_chars`` after trimming, or ignored ones, are no partials; a null duration
is 0; at equal times answers and starts come before rows, and rows in the order of ``ord``; rows without session or
time are left out. In a batch a session ends after its last answer, in a stream it goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.streaming.fold import Keeper, walked, with_rocksdb

SHOWN = "session_id string, number bigint, text string, started_ms bigint, shown_ms bigint"
STATE = "number bigint, newest string, newest_at bigint, takes bigint, asked string, began bigint, flying string, ends bigint, free bigint"


@dataclass(frozen=True)
class Throttle:
    interval_ms: int = 1000
    min_chars: int = 6
    ignored: tuple[str, ...] = ()


class Conflator:
    """The requests of a session; ``number`` counts those started, shown or not."""

    def __init__(self, number=0, newest=None, newest_at=None, takes=None, asked=None, began=None, flying=None, ends=None, free=None, rules: Throttle = Throttle()) -> None:
        self.number, self.newest, self.newest_at, self.takes, self.asked = number, newest, newest_at, takes, asked
        self.began, self.flying, self.ends, self.free, self.rules = began, flying, ends, free, rules

    def state(self) -> tuple:
        return self.number, self.newest, self.newest_at, self.takes, self.asked, self.began, self.flying, self.ends, self.free

    def due(self) -> int | None:
        """When the next answer comes or the next request starts."""
        if self.ends is not None:
            return self.ends
        if self.newest is None or self.newest == self.asked:
            return None
        return max(self.newest_at, self.free or 0, self.newest_at if self.began is None else self.began + self.rules.interval_ms)

    def advance(self, to: float) -> Iterator[tuple]:
        while (at := self.due()) is not None and at <= to:
            if self.ends is not None:
                yield self.number, self.flying, self.began, at
                self.flying, self.ends, self.free = None, None, at
            else:
                self.number += 1
                self.began, self.asked, self.flying, self.ends = at, self.newest, self.newest, at + (self.takes or 0)

    def row(self, kind: str, text: str | None, at: int, takes: int | None) -> Iterator[tuple]:
        yield from self.advance(at)
        if kind == "final":
            self.newest = self.asked = self.began = self.flying = self.ends = self.free = None
            return
        said = (text or "").strip()
        if len(said) >= self.rules.min_chars and said not in self.rules.ignored:
            self.newest, self.newest_at, self.takes = said, at, takes
            yield from self.advance(at)

    def end(self) -> Iterator[tuple]:
        yield from self.advance(inf)


_FIELDS = ["kind", "text", "ms", "takes_ms"]


def _plain(rows: DataFrame) -> DataFrame:
    known = rows.where("session_id is not null and at is not null")
    return known.select(
        F.col("session_id").cast("string"), F.col("ord").cast("long"), "kind", "text", F.col("at").cast("timestamp").alias("at"),
        F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.col("takes_ms").cast("long"),
    )


def conflated(rows: DataFrame, rules: Throttle = Throttle()) -> DataFrame:
    """Answers shown in complete sessions; ``rows`` (session_id, ord, kind partial or final, text, at, takes_ms)."""
    return walked(_plain(rows), "session_id", ["ms", "ord"], _FIELDS, lambda: Conflator(rules=rules), SHOWN)


def conflated_stream(rows: DataFrame, rules: Throttle = Throttle(), delay: str = "1 second") -> DataFrame:
    """The same over a stream whose sessions come in order; the watermark fires the timers."""
    with_rocksdb(rows.sparkSession)
    start = lambda *state: Conflator(*state, rules=rules)
    keeper = Keeper(start, _FIELDS, ["ms", "ord"], STATE, ["session_id", "number", "text", "started_ms", "shown_ms"], timers=True)
    return _plain(rows).withWatermark("at", delay).groupBy("session_id").transformWithState(keeper, SHOWN, "append", "EventTime")
