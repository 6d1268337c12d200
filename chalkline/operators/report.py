"""Reports as rows: the lines of a Markdown table, in order, ready for a text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(value: Column, digits: int | None = None, missing: str = "-") -> Column:
    """A value as text of a cell: rounded, without bars and line breaks, a mark where there is none."""
    text = F.format_number(value, digits) if digits is not None else value.cast("string")
    return F.coalesce(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\s+", " "), F.lit(missing))


def markdown_table(rows: DataFrame, title: str, order: list[Column], columns: dict[str, Column], empty: str = "nothing measured") -> DataFrame:
    """(line_no, line): heading, blank line, header, rule, and a line for each row in the given order.

    ``rows`` is the result of an aggregation, some lines of a report, and is numbered in one task. Without rows the
    table gives way to the line ``empty``.
    """
    n = F.row_number().over(Window.orderBy(*order))
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((n + 4).cast("long").alias("line_no"), bar(list(columns.values())).alias("line"))
    some = body.agg(F.count("*").alias("n"))
    head = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines = F.when(F.col("n") > 0, F.array(*[F.lit(x) for x in head])).otherwise(F.array(*[F.lit(x) for x in [*head[:2], empty]]))
    top = some.select(F.posexplode(lines).alias("p", "line")).select((F.col("p") + 1).cast("long").alias("line_no"), "line")
    return top.unionByName(body)
