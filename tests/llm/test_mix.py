"""The mix against plain dealing of shares, and its edge cases."""

import hashlib
import math
import random
import re
from fractions import Fraction

import pytest

from chalkline.llm import mix

SCHEMA = "doc_id long, text string, source string, size string, target string, number long, weight long, _source string, _part long"


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Shares are dealt by weight; what is over a source's limit is dealt again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    got, left, open_ = {s: Fraction(0) for s in names}, share * sum(sizes.values()), list(names)
    while left > 0 and open_:
        whole, over = sum(weight[s] for s in open_), Fraction(0)
        for s in open_:
            got[s] += left * weight[s] / whole
            if got[s] > most * sizes[s]:
                over += got[s] - most * sizes[s]
                got[s] = Fraction(most * sizes[s])
        left, open_ = over, [s for s in open_ if got[s] < most * sizes[s]]
    return got


def plain(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, size):
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    out = []
    for (key, _, s), n in zip(rows, size):
        rate = float(want[s]) / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.sha256(f"mix/1:{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((key, n, sizes[s], round(float(want[s]), 6), n * (math.floor(rate) + (u < rate - math.floor(rate)))))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, s, "clash", "clash", 1, 1, "clash", 1) for k, t, s in rows], SCHEMA)


def taken(df):
    made = mix.with_copies(df)
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r["size"] * r.copies) for r in made.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_plain(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "\U0001f600", "zz", *(f"s{k}" for k in range(rng.randrange(1, 40)))]
    rows = [(k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 60]))), rng.choice(names)) for k in range(400)]
    rows += [(400 + k, "hot " * 30, "s0") for k in range(200)] + [(None, "x y", "a"), (7, None, "only null"), (7, "  \t\n", "zz"), (8, "word " * 40_000, "long")]
    assert taken(frame(spark, rows)) == plain(rows)


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    rows = [(k, "a b c", f"s{k % 9}" if k % 10 else None) for k in range(200)]
    monkeypatch.setattr(mix, "BROADCAST_SOURCES", 3)
    assert taken(frame(spark, rows)) == plain(rows)


def test_taken_words_come_near_targets_and_rows_repeat(spark):
    rows = [(k, "w " * (1 + k % 50), f"s{k % 3}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = [r.asDict() for r in mix.with_copies(df).collect()]
    for s in ("s0", "s1", "s2"):
        own = [r for r in made if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) / own[0]["target"] - 1) < 0.05
    assert max(r["copies"] for r in made) <= 2
    out = mix.mixed(df)
    assert out.columns == ["doc_id", "text", "source", "copy"] and out.count() == sum(r["copies"] for r in made)
    assert out.groupBy("doc_id", "copy").count().where("count > 1").isEmpty()
    assert made == [r.asDict() for r in mix.with_copies(df).collect()]


def test_nothing_to_mix(spark):
    assert mix.with_copies(frame(spark, [])).count() == 0
    assert taken(frame(spark, [(1, None, "a"), (2, " ", None)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_share_over_the_limit_fills_all(spark):
    got = mix.with_copies(frame(spark, [(1, "a b", "a"), (2, "c", "b")]), share=(9, 1), most=3)
    assert sorted((r.doc_id, r.copies) for r in got.collect()) == [(1, 3), (2, 3)]
