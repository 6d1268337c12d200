"""Spelling variants against all pairs of words by plain Python."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chalkline.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def plain_words(docs):
    n = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 199 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 5}


@pytest.mark.parametrize(("seed", "letters", "longest"), [(1, "ab", 7), (2, "ab", 12), (3, "abcdé", 5), (4, "abcdefghijklmnop", 3), (5, "a", 30)])
def test_near_words_equal_all_pairs(spark, seed, letters, longest):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest + 1))) for _ in range(250)}
    for w in list(words):
        at = rng.randrange(len(w) + 1)
        words.add(w[:at] + rng.choice(letters) + w[at:])
    count = {w: rng.choice([5, 5, 6, 25, 30, 130, 700]) for w in words}
    got = spelling.variants(spark.createDataFrame(sorted(count.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_variants(count)


def test_each_pair_is_met_once_and_few_words_are_merged(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(10)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    merged = spelling._merged(df)
    assert merged.groupBy("word").count().agg(F.max("count")).first()[0] <= len(words).bit_length() + 1
    pairs = sum(one_edit(a, b) for a in words[::40] for b in words)
    got = {r.word: r.n_near for r in spelling.near(df).collect()}
    assert sum(got.get(w, 0) for w in words[::40]) == pairs


def test_documents_equal_plain(spark):
    rng = random.Random(3)
    stems = ["Handlung", "handßlung", "ÀpfelÖl", "letters", "lettrs", "LETTERS", "kurz", "wandern", "wandert", "wanderte", "a" * 40]
    docs = [(k, " ".join(rng.choice(stems) for _ in range(rng.randrange(60)))) for k in range(300)]
    docs += [(None, "letters letters"), (5, None), (6, ""), (7, "\n\t 12345 "), (8, "x" * 60_000), (9, "wandern" * 1), (9, "wandern" * 1)]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, word string, n long")
    got = spelling.variants(spelling.counted(spelling.words_of(df))).collect()
    assert sorted(map(tuple, got), key=repr) == plain_variants(plain_words(docs))


def test_slips_are_found(spark):
    """With a slip at every second run, each variant has the run as its form."""
    df = spark.createDataFrame([(k, "constant " * 5) for k in range(400)], "doc_id long, text string")
    got = {r.word: r.form for r in spelling.variants(spelling.counted(spelling.words_of(df, slips=7))).collect()}
    assert got.pop("constant") is None and got and set(got.values()) == {"constant"}


def test_empty(spark):
    assert spelling.variants(spelling.counted(spelling.words_of(spark.createDataFrame([], "doc_id long, text string")))).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, 5), ("alone!", 7), ("nocount", None)], "word string, n long")).collect() == [("alone!", None, "alone!", 7, 0, None)]


def test_chain_of_forms(spark):
    words = [("abcdefg"[:k] + "x" * (12 - k), 5**k) for k in range(1, 8)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]}
