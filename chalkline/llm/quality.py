"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate over measures of a text. Costs (seconds over a sample, for each measure and each look at the
text) and selectivity (the rows of the sample that a rule rejects) are estimated once; the cascade then asks rules in
order of rejection per cost, each time among the rows that are left and for the cost that is not paid yet, and a text
that one rule rejects is not looked at by the next. Where only the kept rows are wanted (``kept_rows``), a measure is worked out just
before the first rule that needs it, for the texts that are left. The order changes the work, never the
verdict.

Defined results: a null text has no words, lines or symbols, so ``min_words`` rejects it; repeated
rows are judged alike; an empty table keeps the given order of the rules; other columns pass through
(``measured`` and ``judge`` replace those named like a result; names that begin with ``_q_`` are taken).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that costs and selectivities are estimated on, none longer than so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 50_000
#: Runs of a job of which the shortest counts, and the seconds below which times are not told apart.
TIMED, LEAST_COST = 1, 0.002

# White space between words, and the characters that count as symbols.
SPACES = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _words(t: str) -> str:
    return f"array_remove(split(coalesce({t}, ''), '{SPACES}'), '')"


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over the columns of ``measured`` and the text ``{t}``; true means rejected."""

    name: str
    rejects: str


#: The base rules, then those of the cascade. Measures: see ``measured``.
BASE_RULES = (
    Rule("min_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
CASCADE_RULES = (
    Rule("symbols", "n_symbols > 0.5 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > size(split(coalesce({t}, ''), '\\n'))"),
    Rule("shouting", r"3 * regexp_count(coalesce({t}, ''), '\\p{{Lu}}') > 2 * word_chars"),
    Rule("exclamations", "2 * regexp_count(coalesce({t}, ''), '!+') > n_words"),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OF_WORDS = ("n_words", "word_chars", "n_repeat_words")


def _with_measures(df: DataFrame, t: str, names: list[str], hash_bits: int = 64) -> DataFrame:
    """``df`` with the named measures and their helper columns ``_q_...``; helpers that are there are used.

    Three-word windows are compared by 64-bit hashes, of which as many low bits as positions need give way
    to the position, so one sort of plain numbers brings equal hashes together. Neighbours in that order
    are then compared word by word; should hashes of different windows be equal, the windows themselves
    are sorted. ``hash_bits`` weakens the hashes for tests of that.
    """
    if "_q_words" not in df.columns:
        df = df.withColumn("_q_words", F.expr(_words(t)))
    simple = {
        "n_words": "cast(size(_q_words) as bigint)",
        "word_chars": "cast(length(array_join(_q_words, '')) as bigint)",
        "n_symbols": f"cast(regexp_count(coalesce({t}, ''), '{SYMBOLS}') as bigint)",
    }
    df = df.withColumns({n: F.expr(simple[n]) for n in names if n in simple})
    if "n_dup_lines" in names:
        df = df.withColumn("_q_lines", F.expr(f"filter(split(coalesce({t}, ''), '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
        df = df.withColumn("n_dup_lines", F.expr("cast(size(_q_lines) - size(array_distinct(_q_lines)) as bigint)")).drop("_q_lines")
    if "n_repeat_words" in names:
        low = "(shiftleft(1L, _q_bits) - 1)"
        mask = "" if hash_bits == 64 else f" & {((1 << hash_bits) - 1) << (63 - hash_bits)}L"
        window = "xxhash64(x, get(_q_hashes, i + 1), get(_q_hashes, i + 2))"
        df = df.withColumns({"_q_hashes": F.expr("transform(_q_words, x -> xxhash64(x))"), "_q_bits": F.expr("cast(ceil(log2(size(_q_words) + 1)) as int)")})
        df = df.withColumn(
            "_q_keys",
            F.expr(
                "sort_array(transform(slice(_q_hashes, 1, greatest(size(_q_hashes) - 2, 0)), (x, i) ->"
                f" shiftleft(shiftrightunsigned({window}{mask}, _q_bits), _q_bits) | cast(i as bigint)))"
            ),
        ).drop("_q_hashes")
        # numbers whose hash equals a neighbour's, in order: few in most texts
        df = df.withColumn(
            "_q_twice",
            F.expr(
                "filter(_q_keys, (x, i) -> shiftrightunsigned(x ^ get(_q_keys, i - 1), _q_bits) = 0"
                " or shiftrightunsigned(x ^ get(_q_keys, i + 1), _q_bits) = 0)"
            ),
        ).drop("_q_keys")
        at = lambda x, k: f"get(_q_words, cast({x} & {low} as int) + {k})"
        before = "get(_q_twice, i - 1)"
        same = " and ".join(f"{at('x', k)} = {at(before, k)}" for k in range(3))
        clash = f"exists(transform(_q_twice, (x, i) -> i > 0 and shiftrightunsigned(x ^ {before}, _q_bits) = 0 and not ({same})), x -> x)"
        windows = "sort_array(transform(sequence(0, size(_q_words) - 3), i -> named_struct('w', concat_ws(' ', get(_q_words, i), get(_q_words, i + 1), get(_q_words, i + 2)), 'i', cast(i as bigint))))"
        exact = f"get(transform(array({windows}), s -> sort_array(transform(filter(s, (x, i) -> x.w <=> get(s, i - 1).w or x.w <=> get(s, i + 1).w), x -> x.i))), 0)"
        df = df.withColumn("_q_at", F.expr(f"if({clash}, {exact}, sort_array(transform(_q_twice, x -> x & {low})))")).drop("_q_twice", "_q_bits")
        df = df.withColumn(
            "n_repeat_words",
            F.expr(
                "aggregate(_q_at, named_struct('n', 0L, 'last', -3L),"
                " (a, x) -> named_struct('n', a.n + least(3L, x - a.last), 'last', x), a -> a.n)"
            ),
        ).drop("_q_at")
    return df


def _settled(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the named columns behind a generator of one row: a filter on them stays above what makes them."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def measured(docs: DataFrame, text: str = "text", hash_bits: int = 64) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``."""
    return _with_measures(docs.drop("_q_words"), f"`{text}`", list(MEASURES), hash_bits).drop("_q_words")


def _asked(rule: Rule, text: str) -> F.Column:
    return F.expr(rule.rejects.format(t=f"`{text}`"))


def _needs(rule: Rule) -> list[str]:
    """The units of cost that a rule asks for: the split into words, its measures, its own look at the text."""
    measures = [m for m in MEASURES if m in rule.rejects]
    return [*(["words"] if any(m in _OF_WORDS for m in measures) else []), *measures, *([f"text of {rule.name}"] if "{t}" in rule.rejects else [])]


@dataclass(frozen=True)
class Estimates:
    """``costs``: seconds of each unit over the sample; ``rejects``: for each rule, whether it rejects each row of the sample."""

    costs: dict[str, float]
    rejects: dict[str, np.ndarray]


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", rows: int = SAMPLE_ROWS) -> Estimates:
    """Costs and rejections of ``rules`` over at most ``rows`` rows, the first that a few partitions give.

    One job gives the rejections of all rules. Each unit of cost has a job of its own over the sample, once to be
    compiled and ``TIMED`` times to be timed; the time of a job without it is taken off.
    """
    spark = docs.sparkSession
    taken = docs.select(F.col(text).cast("string").alias("_t")).where(F.coalesce(F.length("_t"), F.lit(0)) <= SAMPLE_CHARS).limit(rows).toArrow()
    if not taken.num_rows:
        return Estimates({}, {rule.name: np.zeros(0, bool) for rule in rules})
    sample = spark.createDataFrame(taken).coalesce(1)
    said = _settled(measured(sample, "_t"), list(MEASURES)).select(*[F.coalesce(_asked(r, "_t"), F.lit(False)).alias(r.name) for r in rules]).toArrow()
    rejects = {r.name: said.column(k).to_numpy() for k, r in enumerate(rules)}

    def timed(df: DataFrame, value: F.Column) -> float:
        spent = []
        for _ in range(TIMED + 1):
            began = time.perf_counter()
            df.agg(F.max(value)).collect()
            spent.append(time.perf_counter() - began)
        return min(spent[1:])

    split = sample.withColumn("_q_words", F.expr(_words("_t")))
    idle = timed(sample, F.length("_t"))
    whole = timed(split, F.size("_q_words"))
    costs = {"words": whole - idle}
    for unit in dict.fromkeys(u for r in rules for u in _needs(r) if u != "words"):
        of = next((r for r in rules if unit == f"text of {r.name}"), None)
        if of is None:
            costs[unit] = timed(_with_measures(split, "`_t`", [unit]), F.col(unit)) - (whole if unit in _OF_WORDS else idle)
        else:  # the measures are constants here, so that the look at the text alone is timed
            costs[unit] = timed(sample.withColumns({m: F.length("_t").cast("long") for m in MEASURES}), _asked(of, "_t").cast("int")) - idle
    return Estimates({u: max(c, LEAST_COST) for u, c in costs.items()}, rejects)


def in_order(rules: tuple[Rule, ...], estimates: Estimates) -> list[Rule]:
    """At each place the rule with most rejections, among the rows that are left, for the cost of what it needs beside
    what the rules before it have worked out; ties in the given order."""
    left, known, todo, out = None, set(), list(rules), []
    while todo:

        def gain(rule: Rule) -> float:
            said = estimates.rejects[rule.name]
            n = int((said if left is None else said & left).sum())
            return n / (LEAST_COST + sum(estimates.costs.get(u, 0.0) for u in _needs(rule) if u not in known))

        best = max(todo, key=gain)  # the first of equal ones
        todo.remove(best)
        out.append(best)
        known.update(_needs(best))
        said = estimates.rejects[best.name]
        left = ~said if left is None else left & ~said
    return out


def judge(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = CASCADE_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with all measures, ``base_failed`` and ``kept``."""
    cascade = F
    for rule in in_order(base + rules, estimate(docs, base + rules, text, sample_rows)):
        cascade = cascade.when(_asked(rule, text), False)
    judged = measured(docs, text).withColumns({"base_failed": F.expr(" or ".join(f"({r.rejects})" for r in base)), "kept": cascade.otherwise(True)})
    return _settled(judged, [*MEASURES, "base_failed", "kept"])


def kept_rows(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + CASCADE_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; what a rule rejects costs nothing after it."""
    own = {c: f"_q_own_{c}" for c in docs.columns if c in (*MEASURES, "_q_words")}
    df, t = docs.withColumnsRenamed(own), own.get(text, text)
    for rule in in_order(rules, estimate(docs, rules, text, sample_rows)):
        new = [m for m in MEASURES if m in rule.rejects and m not in df.columns]
        if new:
            df = _settled(_with_measures(df, f"`{t}`", new), [*new, "_q_words"])
        df = df.where(~F.coalesce(_asked(rule, t), F.lit(False)))
    return df.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
