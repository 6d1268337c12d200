"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger has, for each blob,
the rule versions it was scanned with and what they found. A commit scans only the pairs of blob and
rule version that the ledger lacks, each blob once however many paths hold it, and findings are joined
back to all paths. Which path of a blob is read is settled on ids alone; contents move once, to meet
those ids, and are neither sorted nor grouped.

Defined results: a null text is the empty blob; repeated rows share a blob and each get its findings;
an empty table gives no rows; a null path is a path like any other; only the named path column and the
text are read, so other columns cannot clash; a batch committed again changes nothing. Positions are in
characters (code points), ends exclusive. A text of n matches takes n steps in pieces of ``PIECES``.
"""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.commits import CommitLog, none_of
from chalkline.session import cut


@dataclass(frozen=True)
class SecretRule:
    """Matches of ``pattern`` (Java) whose ``group`` has ``least`` characters; ``hint``: text that any match has."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# Shapes of secrets. The first three are the base rules.
RULES = (
    SecretRule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    SecretRule("access", 1, "AKIA[A-Z0-9]{14,}+", hint="AKIA"),
    SecretRule("hex", 1, "(?<![0-9a-f])[0-9a-f]{16,}+"),
    SecretRule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    SecretRule("forge", 1, "(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{30,}+", hint="gh"),
    SecretRule("chat", 1, "(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", hint="xox"),
    SecretRule("jwt", 1, "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", hint="eyJ"),
)
BASE = ("assign", "access", "hex")
#: Matches whose positions are worked out in one go; an array grows by copying, so it is kept short.
PIECES = 1000
#: Blobs looked up by a broadcast, at some 300 bytes each.
BROADCAST_BLOBS = 200_000
SPAN = "start:bigint,rank:int,rule:string,end:bigint"
_SCANS = f"blob_id string, scanned array<string>, findings array<struct<{SPAN}>>"
_VERSIONS = "path {path}, blob_id string"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rule_spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """All accepted matches as structs (start, rank, rule, end).

    The text is split at the matches, so gaps and matches in turn give every position: first where each
    piece of ``PIECES`` matches begins, then the matches in it.
    """
    pattern, no_spans = F.lit(rule.pattern), none_of(SPAN)
    parts = F.arrays_zip(
        F.split(text, rule.pattern).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )

    def after(at: Column, p: Column) -> Column:
        return at + F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.name).alias("rule"), after(a["at"], p).alias("end"))
        found = F.when(F.length(p["part"]) >= rule.least, F.array_append(a["found"], span)).otherwise(a["found"])
        return F.struct(after(a["at"], p).alias("at"), found.alias("found"))

    def of_piece(piece: Column, start: Column) -> Column:
        return F.aggregate(piece, F.struct(start.alias("at"), no_spans.alias("found")), step, lambda a: a["found"])

    zero = F.lit(0).cast("bigint")
    starts = lambda pieces: F.aggregate(
        pieces, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda a, c: F.struct((a["at"] + F.aggregate(c, zero, after)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"],
    )
    pieces = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PIECES)), lambda k: F.slice(p, (k * PIECES + 1).cast("int"), PIECES))
    spans = _bound(parts, lambda p: _bound(pieces(p), lambda c: F.flatten(F.zip_with(c, starts(c), of_piece))))
    asked = text.rlike(rule.pattern)
    return F.when(text.contains(rule.hint) & asked if rule.hint else asked, spans).otherwise(no_spans)


def versions_of(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob_id, content) of every version."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob_id"), content.alias("content"))


class Ledger:
    """Versions seen and blobs scanned, in two logs under ``path`` in a store that all executors share."""

    def __init__(self, versions: CommitLog, scans: CommitLog, rules: tuple[SecretRule, ...] = RULES) -> None:
        self.versions, self.scans, self.rules = versions, scans, rules

    @classmethod
    def fresh(cls, spark: SparkSession, rules: tuple[SecretRule, ...] = RULES, path_type: str = "bigint") -> Ledger:
        """An empty ledger in the cluster's shared folder."""
        return cls(CommitLog.fresh(spark, "versions", _VERSIONS.format(path=path_type)), CommitLog.fresh(spark, "scans", _SCANS), rules)

    def commit(self, batch: str, versions: DataFrame) -> int:
        """Adds the (path, blob_id, content) of a batch; the number of blobs that were scanned for it."""
        self.versions.commit(batch, lambda: versions.select("path", "blob_id"))
        name = f"{batch}|{','.join(r.key for r in self.rules)}"
        before = self.scans.read()
        if not self.scans.commit(name, lambda: scan_unseen(versions, before, self.rules)):
            return 0
        return self.scans.read().count() - before.count()

    def findings(self) -> DataFrame:
        """(path, blob_id, findings) of every version; a blob's findings are those of all its scans."""
        return findings_by_path(self.versions.read(), self.scans.read())


def scan_unseen(versions: DataFrame, scans: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob_id, scanned, findings): one row for each blob that lacks a rule version in ``scans``.

    A blob of one version that no scan knows is scanned where it lies. Only the others (copies, and blobs seen
    before) are looked up: by a broadcast up to ``BROADCAST_BLOBS`` of them, beyond it by a shuffle on blob and path.
    """
    keys, none = F.array(*[F.lit(r.key) for r in rules]), F.array().cast("array<string>")
    ids = versions.groupBy("blob_id").agg(F.min("path").alias("_path"), F.count(F.lit(1)).alias("_n"))
    if scans is None:
        ids = ids.withColumns({"_seen": F.lit(False), "scanned": keys})
    else:
        seen = scans.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("_keys"))
        ids = ids.join(seen, "blob_id", "left").withColumns({"_seen": F.col("_keys").isNotNull(), "scanned": F.array_except(keys, F.coalesce("_keys", none))})
    ids = cut(ids.select(F.col("blob_id").alias("_blob"), "_path", (F.col("_seen") | (F.col("_n") > 1)).alias("_other"), "scanned"))
    others = ids.where("_other")
    if others.count() <= BROADCAST_BLOBS:
        mine = versions.join(F.broadcast(others), versions["blob_id"] == others["_blob"], "left")
        mine = mine.where("_blob is null or (path <=> _path and size(scanned) > 0)").withColumn("scanned", F.coalesce("scanned", keys))
    else:
        asked = ids.where(F.size("scanned") > 0).hint("shuffle_hash")
        mine = versions.join(asked, (versions["blob_id"] == ids["_blob"]) & versions["path"].eqNullSafe(ids["_path"]))
    found = []
    for rank, rule in enumerate(rules):
        spans = rule_spans(F.col("content"), rule, rank)
        found.append(spans if scans is None else F.when(F.array_contains("scanned", rule.key), spans).otherwise(none_of(SPAN)))
    scanned = mine.select("blob_id", "scanned", F.array_sort(F.concat(*found)).alias("findings"))
    return scanned.groupBy("blob_id").agg(F.any_value("scanned").alias("scanned"), F.any_value("findings").alias("findings"))


def findings_by_path(versions: DataFrame, scans: DataFrame) -> DataFrame:
    """(path, blob_id, findings) of every version; findings are null where there are none."""
    found = scans.where(F.size("findings") > 0)
    found = cut(found.groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings")))
    return versions.select("path", "blob_id").join(found, "blob_id", "left")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; the empty string where there are none."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(parts, ","), F.lit(""))
