"""Sequential machines over keyed rows: a batch is walked in order, a stream keeps each key's machine as state.

A machine is made by ``start()``; ``row(*fields)`` takes one row and ``end()`` ends its key, both give output tuples.
For streams it also has ``state()`` (a tuple, read back by ``start(*state)``) and ``due()`` (when it wants to act
without a row, in milliseconds of event time, or None) with ``advance(to)``.

A task walks one key after the other in the order of the rows, so it holds one machine and one batch, never a key's
rows. A key's rows are worked off in one task, since each depends on the ones before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

#: Output rows that leave a task at once.
ROWS = 10_000


def walked(rows: DataFrame, key: str, order: list[str], fields: list[str], start: Callable, schema: str | StructType) -> DataFrame:
    """Output of each key's machine over its rows in order; ``schema`` begins with the key's column."""
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def pieces(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made) if made else [()] * len(arrow), arrow)], schema=arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, out = None, None, []
        for batch in batches:
            for name, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if machine is None or name != current:
                    if machine is not None:
                        out += [(current, *r) for r in machine.end()]
                    current, machine = name, start()
                out += [(name, *r) for r in machine.row(*values)]
                if len(out) >= ROWS:
                    yield pieces(out)
                    out = []
        if machine is not None:
            out += [(current, *r) for r in machine.end()]
        yield pieces(out)

    dealt = rows.select(key, *fields, *[F.col(c).alias(f"_order{k}") for k, c in enumerate(order)])
    dealt = dealt.repartition(F.col(key)).sortWithinPartitions(key, *[f"_order{k}" for k in range(len(order))])
    return dealt.select(key, *fields).mapInArrow(walk, schema)


class Keeper(StatefulProcessor):
    """Keeps a machine for each key. Rows of a micro-batch are sorted by ``order``; ``forget_ms`` without rows end a key's state."""

    def __init__(self, start: Callable, fields: list[str], order: list[str], state: str, names: list[str], timers: bool = False) -> None:
        self.start, self.fields, self.order, self.schema, self.names, self.timers = start, fields, order, state, names, timers

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", self.schema)

    def _machine(self):
        return self.start(*self.kept.get()) if self.kept.exists() else self.start()

    def _rows(self, key, made) -> Iterator[Row]:
        for values in made:
            yield Row(**dict(zip(self.names, (key[0], *values))))

    def _keep(self, machine) -> None:
        self.kept.update(machine.state())
        due = machine.due() if self.timers else None
        if due is not None:
            self.handle.registerTimer(int(due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        machine = self._machine()
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            yield from self._rows(key, machine.row(*(row[f] for f in self.fields)))
        self._keep(machine)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        machine = self._machine()
        yield from self._rows(key, machine.advance(expiredTimerInfo.getExpiryTimeInMs()))
        self._keep(machine)

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession) -> None:
    """State of transformWithState lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
