"""Locale maps and JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def locale_map(locales: Column, translations: Column, source: Column) -> Column:
    """locale -> struct(text, isFallback): a blank or missing translation shows the source text."""

    def entry(locale: Column) -> Column:
        t = F.trim(translations[locale])
        return F.struct(F.when(_blank(t), F.trim(source)).otherwise(t).alias("text"), _blank(t).alias("isFallback"))

    return F.map_from_arrays(locales, F.transform(locales, entry))


def first_non_blank(merged: Column, new: Column) -> Column:
    """Union of two maps; per key the first value that is not blank."""
    return F.map_zip_with(merged, new, lambda _, a, b: F.when(_blank(a), b).otherwise(a))


def missing_locales(locales: Column, translations: Column) -> Column:
    return F.array_except(locales, F.map_keys(F.map_filter(translations, lambda _, v: ~_blank(v))))


def overlaid(defaults: Column, overrides: Column) -> Column:
    return F.map_zip_with(defaults, overrides, lambda _, a, b: F.coalesce(b, a))


def parsed_locales(content: Column, locales: list[str]) -> list[Column]:
    """One column for each locale of a JSON object; '' where it is missing or the text is no object."""
    got = F.from_json(content, "map<string,string>")
    return [F.coalesce(got[x], F.lit("")).alias(x) for x in locales]


def strict_schema(locales: list[str]) -> str:
    """DDL of an object with exactly these string members."""
    return ", ".join(f"`{x}` string" for x in locales)


def shown_text(translations: Column, locale: str, source: Column) -> Column:
    """struct(text, fallback) of a history row in one locale."""
    entry = translations[locale]
    return F.struct(F.coalesce(entry["text"], source).alias("text"), F.coalesce(entry["isFallback"], F.lit(True)).alias("fallback"))


def worker_status(raw: Column, allowed: tuple[str, ...]) -> Column:
    """Status of a JSON object, or of a bare word; null unless it is allowed."""
    status = F.coalesce(F.from_json(raw, "status string")["status"], raw)
    return F.when(status.isin(*allowed), status)


def cancellation(first: Column, second: Column) -> Column:
    """struct(details, code) of a cancelled result: the first of two places that has details."""
    return F.when(first["details"].isNotNull(), first).when(second["details"].isNotNull(), second)
