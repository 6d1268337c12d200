"""Order of the quality rules, and URL tables with clashing columns."""

import time

import numpy as np
from pyspark.sql import functions as F

from chalkline.llm import quality, urls
from chalkline.session import table


def bits(text):
    return np.array([c == "1" for c in text], bool)


def test_order_is_conditional_on_the_rows_that_are_left():
    """The dear rule rejects most, but a cheap one before it leaves it nothing; a shared measure is paid once."""
    cheap, dear, other = quality.Rule("cheap", "n_words < 5"), quality.Rule("dear", "n_repeat_words > 5"), quality.Rule("other", "n_dup_lines > 1")
    rejects = {"cheap": bits("1111000000"), "dear": bits("1111100000"), "other": bits("0000011000")}
    costs = {"words": 0.1, "n_words": 0.01, "n_repeat_words": 2.0, "n_dup_lines": 0.5}
    order = quality.in_order((dear, other, cheap), quality.Estimates(costs, rejects))
    assert [r.name for r in order] == ["cheap", "other", "dear"]
    twice = quality.Rule("twice", "n_repeat_words > 9")
    rejects["twice"] = bits("0000000110")
    # what the dear rule works out, the other rule on it has for nothing
    order = quality.in_order((dear, twice, other), quality.Estimates({**costs, "n_dup_lines": 50.0}, rejects))
    assert [r.name for r in order] == ["dear", "twice", "other"]
    tie = quality.in_order((dear, other), quality.Estimates({}, {"dear": bits(""), "other": bits("")}))
    assert tie == [dear, other]


def test_estimates_of_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rules = quality.BASE_RULES + quality.CASCADE_RULES
    quality.estimate(docs, rules)
    began = time.perf_counter()
    found = quality.estimate(docs, rules)
    assert time.perf_counter() - began < 10
    assert found.costs["n_repeat_words"] > found.costs["n_words"] and min(found.costs.values()) > 0
    want = {r.name: [] for r in rules}
    rows = docs.where(F.length("text") <= quality.SAMPLE_CHARS).limit(quality.SAMPLE_ROWS)
    for r in quality.measured(rows).select(*[F.expr(x.rejects.format(t="text")).alias(x.name) for x in rules]).collect():
        for k, v in r.asDict().items():
            want[k].append(bool(v))
    assert {k: int(v.sum()) for k, v in found.rejects.items()} == {k: sum(v) for k, v in want.items()}
    assert quality.estimate(docs.limit(0), rules).costs == {}


def test_url_columns_pass_through(spark):
    rules = spark.createDataFrame(urls.RULES, "rule_host string, rule_path string, action string")
    pages = spark.createDataFrame([(1, "http://a.net/x", "h", "p", "b", "r", "a"), (2, "http://" + "a" * 50_000 + ".org/fr/" + "x" * 50_000, None, None, None, None, None)],
                                  "page_id long, url string, _host string, _path string, _best string, rule string, h string")
    got = urls.judge(pages, rules).orderBy("page_id").collect()
    assert (got[0]["_host"], got[0]["_path"], got[0]["_best"], got[0].h, got[0].rule, got[0].verdict) == ("h", "p", "b", "a", "net/", "block")
    assert (got[1].rule, got[1].verdict, len(got[1].path)) == ("org/fr/", "allow", 50_004)
