"""Ordered emission: a reorder buffer for each session, released by number, or by the watermark where one is missing.

A packet whose number is the next one leaves at once, and with it those that waited behind it. One that comes early
waits; when the watermark reaches its event time, what is missing before it counts as lost and it leaves with all
that wait before it. A packet whose number has been passed, or that is there already, is late: it is given as such,
so that late ones can be counted. Hence, if no packet comes later than the watermark's delay, the packets of a session
leave sorted by number, whatever their order of arrival.

Defined results: packets without session, number or time are left out; a session's first number is ``first``; a
stream drops packets older than the watermark before they come here (they are in its numRowsDroppedByWatermark).
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chalkline.streaming.fold import walked, with_rocksdb

EMITTED = "session_id string, place bigint, sequence bigint, text string, late boolean"


class Reorder:
    """``waiting`` maps number -> (text, time); it may be a dict or a view of stored state."""

    def __init__(self, waiting: MutableMapping, following: int, place: int = 0) -> None:
        self.waiting, self.following, self.place = waiting, following, place

    def _give(self, sequence: int) -> tuple:
        self.place += 1
        text, _ = self.waiting.pop(sequence)
        return self.place, sequence, text, False

    def _run(self) -> Iterator[tuple]:
        while self.following in self.waiting:
            yield self._give(self.following)
            self.following += 1

    def put(self, sequence: int, text: str | None, at: int) -> Iterator[tuple]:
        if sequence < self.following or sequence in self.waiting:
            yield None, sequence, text, True
            return
        self.waiting[sequence] = (text, at)
        yield from self._run()

    def release(self, to: int | None) -> Iterator[tuple]:
        """What the watermark ``to`` (None: the end) does not let wait any longer."""
        due = [s for s, (_, at) in self.waiting.items() if to is None or at <= to]
        if due:
            last = max(due)
            for sequence in sorted(s for s in self.waiting if s <= last):
                yield self._give(sequence)
            self.following = last + 1
            yield from self._run()


class _Session:
    """A session in a batch: the watermark is the latest time so far, less the delay."""

    def __init__(self, delay_ms: int, first: int) -> None:
        self.buffer, self.delay, self.latest = Reorder({}, first), delay_ms, None

    def row(self, sequence: int, text: str | None, at: int) -> Iterator[tuple]:
        yield from self.buffer.put(sequence, text, at)
        self.latest = at if self.latest is None else max(self.latest, at)
        yield from self.buffer.release(self.latest - self.delay)

    def end(self) -> Iterator[tuple]:
        yield from self.buffer.release(None)


def _plain(packets: DataFrame) -> DataFrame:
    cast = {"session_id": "string", "sequence": "long", "text": "string", "at": "timestamp"}
    known = packets.where("session_id is not null and sequence is not null and at is not null")
    return known.select(*[F.col(c).cast(t) for c, t in cast.items()], *[c for c in ["ord"] if c in packets.columns])


def in_order(packets: DataFrame, delay_ms: int, first: int = 1) -> DataFrame:
    """Emission of complete sessions: ``packets`` (session_id, ord, sequence, text, at) come in the order of ``ord``."""
    rows = _plain(packets).withColumn("at", F.unix_millis("at"))
    return walked(rows, "session_id", ["ord"], ["sequence", "text", "at"], lambda: _Session(delay_ms, first), EMITTED)


class _Stored(MutableMapping):
    """A session's waiting packets in the state store: only those asked for are read."""

    def __init__(self, state) -> None:
        self.state = state

    def __getitem__(self, sequence: int) -> tuple:
        if not self.state.containsKey((sequence,)):
            raise KeyError(sequence)
        return tuple(self.state.getValue((sequence,)))

    def __setitem__(self, sequence: int, value: tuple) -> None:
        self.state.updateValue((sequence,), value)

    def __delitem__(self, sequence: int) -> None:
        self.state.removeKey((sequence,))

    def __contains__(self, sequence: object) -> bool:
        return self.state.containsKey((sequence,))

    def __iter__(self) -> Iterator[int]:
        return iter([k[0] for k in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())


class _Emitter(StatefulProcessor):
    def __init__(self, first: int) -> None:
        self.first = first

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "sequence long", "text string, at long")
        self.counts = handle.getValueState("counts", "following long, place long")

    def _buffer(self) -> Reorder:
        following, place = self.counts.get() if self.counts.exists() else (self.first, 0)
        return Reorder(_Stored(self.waiting), following, place)

    def _given(self, key, made: Iterator[tuple]) -> Iterator[Row]:
        for place, sequence, text, late in made:
            yield Row(session_id=key[0], place=place, sequence=sequence, text=text, late=late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        buffer = self._buffer()
        for row in rows:
            at = int(row["ms"])
            yield from self._given(key, buffer.put(row["sequence"], row["text"], at))
            if row["sequence"] in buffer.waiting:
                self.handle.registerTimer(at)
        self.counts.update((buffer.following, buffer.place))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        buffer = self._buffer()
        yield from self._given(key, buffer.release(expiredTimerInfo.getExpiryTimeInMs()))
        self.counts.update((buffer.following, buffer.place))

    def close(self) -> None:
        pass


def in_order_stream(packets: DataFrame, delay: str, first: int = 1) -> DataFrame:
    """The same over a stream, with a watermark of ``delay`` behind the latest time of all sessions."""
    with_rocksdb(packets.sparkSession)
    rows = _plain(packets).withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)
    return rows.groupBy("session_id").transformWithState(_Emitter(first), EMITTED, "append", "EventTime")
