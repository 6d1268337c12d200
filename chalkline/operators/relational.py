"""Control-plane relations: optional filters, row-level security, pages, upserts, updates and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filters(rows: DataFrame, **wanted) -> DataFrame:
    """Equality on each given value; None asks for nothing."""
    return rows.where(reduce(lambda a, kv: a & (F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), F.lit(True)))


def visible_courses(courses: DataFrame, owner: str, role: str, viewer: int | None) -> DataFrame:
    """All courses for an administrator, own ones for a professor, none for others."""
    if role == "admin":
        return courses
    return courses.where(F.col(owner) == viewer) if role == "professor" else courses.where(F.lit(False))


def visible_materials(materials: DataFrame, kind: str, session: str, viewer_session: int, lecture: str) -> DataFrame:
    """Lecture material of the session, or of no session."""
    return materials.where((F.col(kind) == lecture) & ((F.col(session) == viewer_session) | F.col(session).isNull()))


def whitelisted(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value)


def page(rows: DataFrame, order: list[str], after: tuple | None = None, limit: int | None = None, default: int = 200, most: int = 500) -> DataFrame:
    """One keyset page: rows after the given key values in the given order, at most 200 (500 if asked for)."""
    if after is not None:
        alternatives = []
        for k in range(len(after)):
            equal = reduce(lambda a, i: a & (F.col(order[i]) == after[i]), range(k), F.lit(True))
            alternatives.append(equal & (F.col(order[k]) > after[k]))
        rows = rows.where(reduce(lambda a, b: a | b, alternatives))
    return rows.orderBy(*order).limit(min(limit or default, most))


def last_wins(log: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The last row of each key by arrival."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in arrival])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(snapshot: DataFrame, log: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """``snapshot`` with the last log row of each key in place of its own."""
    new = last_wins(log, keys, arrival).select(*snapshot.columns)
    return snapshot.join(new.select(*keys), keys, "left_anti").select(*snapshot.columns).unionByName(new)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the non-null values of ``changes`` by key, and whether a row was ``affected``."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, rows[key] == new["_key"], "left").withColumn("affected", F.col("_key").isNotNull())
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_key", *[f"_{c}" for c in columns])


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti").select(*rows.columns)


def cascaded(children: DataFrame, parent_key: str, gone: DataFrame, key: str, on_delete: str) -> DataFrame:
    """Children after parents were deleted: removed (cascade), unlinked (set null), or an error (restrict)."""
    lost = gone.select(F.col(key).alias("_gone")).distinct()
    if on_delete == "cascade":
        return children.join(lost, F.col(parent_key) == F.col("_gone"), "left_anti")
    joined = children.join(lost, F.col(parent_key) == F.col("_gone"), "left")
    if on_delete == "set null":
        return joined.withColumn(parent_key, F.when(F.col("_gone").isNull(), F.col(parent_key))).drop("_gone")
    refused = F.assert_true(F.col("_gone").isNull(), F.lit("a deleted row is still referred to"))
    return joined.where(refused.isNull()).drop("_gone")


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, or an error when run if a key occurs twice."""
    w = Window.partitionBy(key)
    checked = rows.withColumn("_n", F.count(F.lit(1)).over(w))
    return checked.where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))).isNull()).drop("_n")


def updated_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """``rows`` with new values where the condition holds, and whether a row was ``affected``."""
    hit = F.coalesce(condition, F.lit(False))
    out = rows.withColumn("affected", hit)
    return out.withColumns({c: F.when(F.col("affected"), v).otherwise(F.col(c)) for c, v in values.items()})
