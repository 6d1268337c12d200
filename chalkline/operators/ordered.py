"""Ordered-sequence operators as windows: islands, forward fill, monotone filters, history, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chalkline.streaming.fold import walked


def islands(rows: DataFrame, keys: list[str], order: str, same: str) -> DataFrame:
    """``rows`` with ``island``: consecutive values of ``order`` with equal ``same`` share one."""
    w = Window.partitionBy(*keys).orderBy(order)
    joined = (F.lag(order).over(w) == F.col(order) - 1) & (F.lag(same).over(w) == F.col(same))
    marked = rows.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("island", F.sum("_new").over(w)).drop("_new")


def merged_islands(rows: DataFrame, keys: list[str], order: str, same: str, text: str, least: int = 0) -> DataFrame:
    """One row for each island: first and last place, and its texts in order; short ones go."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    out = islands(rows, keys, order, same).groupBy(*keys, same, "island").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(parts, "\n").alias("text")
    )
    return out.where(F.length("text") >= least)


def filled(rows: DataFrame, keys: list[str], order: str, value: str, into: str) -> DataFrame:
    """The last non-null ``value`` at or before each row."""
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def monotone(rows: DataFrame, keys: list[str], arrival: str, sequence: str) -> DataFrame:
    """Rows whose sequence exceeds all that arrived before; late ones go."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(sequence).over(before), F.lit(0))
    return rows.withColumn("_seen", seen).where(F.col(sequence) > F.col("_seen")).drop("_seen")


def monotone_until(rows: DataFrame, keys: list[str], arrival: str, sequence: str, final: str) -> DataFrame:
    """Drafts in monotone order; the count starts anew after each final row."""
    w = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    epochs = rows.withColumn("_epoch", F.coalesce(F.sum(F.col(final).cast("int")).over(w), F.lit(0)))
    return monotone(epochs.where(~F.col(final)), [*keys, "_epoch"], arrival, sequence).drop("_epoch")


def history(rows: DataFrame, keys: list[str], order: str, text: str, n: int = 3) -> DataFrame:
    """``rows`` with up to ``n`` texts strictly before each, oldest first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return rows.withColumn("history", F.collect_list(text).over(w))


def retained(rows: DataFrame, keys: list[str], order: str, at: str, now: str, most: int = 30, seconds: int = 300) -> DataFrame:
    """The newest ``most`` rows that are younger than ``seconds`` at ``now``; the newest one always stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    young = F.col(at) > F.col(now) - F.expr(f"interval {seconds} seconds")
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= most) & (young | (F.col("_n") == 1))).drop("_n")


def newest(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_wins(rows: DataFrame, key, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def budget_prefix(rows: DataFrame, keys: list[str], order: list[str], text: str, items: int = 500, chars: int = 8000, extra: int = 0) -> DataFrame:
    """Rows in order while their number and their characters stay within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumns({"_n": F.row_number().over(w), "_used": F.sum(F.length(text) + extra).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.where((F.col("_n") <= items) & (F.col("_used") <= chars)).drop("_n", "_used")


def numbered(rows: DataFrame, keys: list[str], order: list[str], base: str | None = None) -> DataFrame:
    """``rows`` with the next sequence numbers after ``base`` (the last one used so far)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("sequence", (n + (F.coalesce(F.col(base), F.lit(0)) if base else 0)).cast("long"))


def stale_skips(jobs: DataFrame, keys: list[str], order: str, queued: str, started: str, most_ms: int = 3000) -> DataFrame:
    """``jobs`` with ``skipped``: waited over the limit while a newer job was already queued."""
    following = F.lead(queued).over(Window.partitionBy(*keys).orderBy(order))
    waited = (F.col(started) - F.col(queued)) * 1000
    return jobs.withColumn("skipped", F.coalesce((waited > most_ms) & (following <= F.col(started)), F.lit(False)) if most_ms > 0 else F.lit(False))


def latest_per_window(rows: DataFrame, keys: list[str], at: str, seconds: int = 1) -> DataFrame:
    """The last row of each key in each window of time: a throttle where the newest wins."""
    slot = F.floor(F.col(at).cast("double") / seconds)
    w = Window.partitionBy(*keys, slot).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def running_text(rows: DataFrame, keys: list[str], order: str, delta: str, into: str) -> DataFrame:
    """``rows`` with all deltas of their item so far, joined; null before the first one.

    An item's rows are walked in order: a task holds the text so far, not a window of all deltas for each row.
    """
    others = [c for c in rows.columns if c not in keys and c != into]
    schema = StructType([StructField("_key", rows.select(F.struct(*keys).alias("k")).schema["k"].dataType), *(rows.schema[c] for c in others), StructField(into, StringType())])
    at = others.index(delta)

    class Text:
        def __init__(self) -> None:
            self.text = None

        def row(self, *values):
            if values[at] is not None:
                self.text = (self.text or "") + values[at]
            yield *values, self.text

        def end(self):
            return iter(())

    out = walked(rows.withColumn("_key", F.struct(*keys)), "_key", [order], others, Text, schema)
    return out.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *others, into)


def whole_text(rows: DataFrame, keys: list[str], order: str, delta: str, into: str) -> DataFrame:
    """One row for each item with all its deltas joined in order; null without any."""
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col(delta).isNotNull(), F.struct(order, delta)))), lambda x: x[delta])
    return rows.groupBy(*keys).agg(F.when(F.count(delta) > 0, F.array_join(parts, "")).alias(into))
