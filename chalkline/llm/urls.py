"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence.

A URL is expanded into the expressions that a rule could have: of its host's suffixes and its path's
prefixes those of the shapes (number of host labels, length of path) that occur among the rules, however
many those are: the driver holds the distinct shapes, which are far fewer than rules. Expressions meet
the rules by equality of the first 32 bits of a SHA-256 digest; a hit counts when the full digests
agree. The longest rule wins; of rules of equal length the one that blocks, then the first by text.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; repeated rows
and null keys are judged alike; without rules every URL gets the default verdict; other columns pass
through (those named host, path, rule and verdict are replaced).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many rules are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000
# Host and path of the registered rules, with their verdicts.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_PARTS = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    text = f"coalesce(cast(`{url}` as string), '')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns(
        {"host": F.expr(f"translate(regexp_extract({text}, {_PARTS}, 1), '{upper}', '{lower}')"), "path": F.expr(f"regexp_extract({text}, {_PARTS}, 2)")}
    )


def _digested(rules: DataFrame) -> DataFrame:
    rule = F.concat("rule_host", "rule_path")
    one = rules.where("rule_host is not null and rule_path is not null").select(
        rule.alias("rule"), "action", F.sha2(rule, 256).alias("digest"),
        F.size(F.split("rule_host", "\\.")).alias("labels"), F.length("rule_path").alias("path_length"),
    )
    return one.withColumn("prefix", F.substring("digest", 1, 8)).distinct()


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has rule_host, rule_path and action."""
    known = _digested(rules)
    shapes = known.groupBy("labels").agg(F.sort_array(F.collect_set("path_length")).alias("lengths")).collect()
    pages = with_host_and_path(pages, url)
    if not shapes:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    known = F.broadcast(known) if few else known

    urls = pages.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffix = lambda s: F.array_join(F.slice(labels, -s["l"], s["l"]), ".")
    of_shape = lambda s: F.transform(F.filter(s["p"], lambda n: n <= F.length("path")), lambda n: F.concat(suffix(s), F.substring("path", F.lit(1), n)))
    all_shapes = F.from_json(F.lit(json.dumps([{"l": r.labels, "p": list(r.lengths)} for r in shapes])), "array<struct<l:int,p:array<int>>>")
    expressions = F.flatten(F.transform(F.filter(all_shapes, lambda s: s["l"] <= F.size(labels)), of_shape))
    hits = urls.select("host", "path", F.explode(expressions).alias("expression"))
    hits = hits.withColumn("_digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("_digest", 1, 8))
    hits = hits.join(known, "prefix").where(F.col("_digest") == F.col("digest"))
    rank = F.struct((-F.length("rule")).alias("n"), (F.col("action") != "block").alias("b"), F.col("rule").alias("r"))
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), rank).alias("_best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("_best.rule").alias("r"), F.col("_best.action").alias("a"))
    joined = pages.join(best, (pages.host == best.h) & (pages.path == best.p), "left")
    kept = [pages[f"`{c}`"] for c in pages.columns if c not in ("rule", "verdict")]
    return joined.select(*kept, best.r.alias("rule"), F.coalesce(best.a, F.lit(default)).alias("verdict"))
