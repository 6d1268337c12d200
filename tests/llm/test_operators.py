"""The training-data operators against plain versions on small tables, with their edge cases."""

import collections
import hashlib
import json
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import decontaminate, jaccard, licenses, packing, perplexity, pii, quality, queries, rollup, secrets, urls
from chalkline.llm.paths import tokenizer_path
from tests.compare import connection, rows

SF = "/root/testdata/sf0.001"
TOKENIZER = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, words string, kept boolean"


def docs_of(spark, texts, **more):
    made = [(i, t, more.get("lang", "en"), "s", None, "clash", "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, SCHEMA)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


EDGES = [None, "", " \n\t ", "one", "one", "x" * 50_000, "tie tie tie tie tie tie", "\n" * 500]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), connection(SF).sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


# 1


def base_pii(t):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_pii_base_equals_patterns():
    rng = random.Random(5)
    parts = ["a@b.c", "@", ".", "..", "1.2.3.4", "256.1.1.1", "+1 (017) 555-7713", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "x_y%z@h-1.d", "9", "00012", "@@", "é", "\n", "1.2.3.4.5.6.7.8"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        got = [(s, pii.KINDS[k], e) for s, k, e, base in pii.find(t) if base]
        assert got == base_pii(t), t


def test_pii_disguised_and_redacted(spark):
    texts = ["mail john.doe (at) mail7 [dot] example [dot] com", "plus one four one two five five five zero one nine nine", "jоhn@exаmple.com", "name at host dot example dot org", "we met at noon. a dot here", None, ""]
    df = docs_of(spark, texts)
    found = [[(s["kind"], s["start"], s["end"]) for s in r.pii_spans] for r in pii.with_pii(df).orderBy("doc_id").collect()]
    assert found == [[("email", 5, 48)], [("phone", 0, 55)], [("email", 0, 16)], [("email", 0, 32)], [], [], []]
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["mail [EMAIL]", "[PHONE]", "[EMAIL]", "[EMAIL]", texts[4], None, ""]
    assert pii.with_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("call plus four 9 one 7 six 2 three 4 five 8 one now", [("phone", 5, 47)]), ("one 2 three 4", []),
        ("host 192 dot 168 dot 1 dot 5 is up", [("ip", 5, 28)]), ("192.168 dot 1.5", [("ip", 0, 15)]), ("1 dot 2 dot 3", []),
        ("to john_at_example_dot_com.", [("email", 3, 26)]), ("j.d-at-mail-dot-example-dot-org", [("email", 0, 31)]), ("look_at_this", []),
        ("john DOT doe AT example DOT com", [("email", 0, 31)]), ("look at example.com", []), ("a dot plan at noon", []),
    ],
)
def test_pii_further_disguises(text, spans):
    assert [(pii.KINDS[k], s, e) for s, k, e, _ in pii.find(text)] == spans


def test_pii_tape_maps_back():
    """Random rewrites against a list with one source part for each character."""
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 30)))
        tape, parts, new = pii._Tape(text), [(i, i + 1) for i in range(len(text))], [False] * len(text)
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(parts) + 1), min(len(parts) + 1, 2 * rng.randrange(3))))
            edits = [(a, z, "X" * rng.randrange(3)) for a, z in zip(cuts[::2], cuts[1::2])]
            tape.rewrite(edits)
            for a, z, s in reversed(edits):
                parts[a:z], new[a:z] = [(parts[a][0], parts[z - 1][1])] * len(s), [True] * len(s)
            assert len(tape.text) == len(parts)
            for _ in range(5 if parts else 0):
                a = rng.randrange(len(parts))
                z = rng.randrange(a, len(parts)) + 1
                assert tape.part(a, z) == (parts[a][0], parts[z - 1][1]) and bool(tape.new_text(a, z)) == any(new[a:z])


def test_pii_very_long_text():
    text = "plain words and (dot) signs. " * 40_000 + "jane (at) example [dot] com"
    assert [(pii.KINDS[k], e - s) for s, k, e, _ in pii.find(text)] == [("email", 27)]


def test_pii_query_digest(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_pii"](spark, SF).collect():
        spans = base_pii(text[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in spans) for kind in pii.KINDS]


# 2


def shingle_set(t):
    w = [x for x in re.split("[ \t-\r]+", t or "") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_join(texts):
    sets = [shingle_set(t) for t in texts]
    part, links = list(range(len(sets))), [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    return [(i, part[i], links[i]) for i in range(len(sets))]


def test_sets_that_share_a_name(spark, monkeypatch):
    """First hashes of one bit: most sets share a name, and are told apart by the second."""
    texts = [sentence(random.Random(k), 30) for k in range(20)] * 2 + EDGES

    def sketcher(n, bands, rows, make=jaccard._sketcher):
        inner = make(n, bands, rows)

        def sketch(batches):
            import pyarrow as pa

            for b in inner(batches):
                low = pa.array([None if x is None else x & 1 for x in b.column(2).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), low, b.column(3), b.column(4)], b.schema.names)

        return sketch

    monkeypatch.setattr(jaccard, "_sketcher", sketcher)
    got = jaccard.jaccard_join(docs_of(spark, texts))
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == plain_join(texts)


def near_copies(rng, n):
    base = sentence(rng, 80).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_join(spark, monkeypatch):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(1, 90)) for _ in range(60)] + near_copies(rng, 40) + near_copies(rng, 5) + EDGES
    texts += [texts[0]] * 3 + ["one two", "one two", "one three"]
    want = plain_join(texts)
    got = [tuple(r) for r in jaccard.jaccard_join(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == want
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # large groups are dealt in blocks
    assert [tuple(r) for r in jaccard.jaccard_join(docs_of(spark, texts)).orderBy("doc_id").collect()] == want


def test_jaccard_groups_and_edges(spark):
    assert jaccard.jaccard_join(docs_of(spark, [])).count() == 0
    df = docs_of(spark, ["a b c d e f"] * 3).union(docs_of(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((tuple(r) for r in jaccard.jaccard_join(df).collect()), key=repr)
    assert got == [(0, 0, 2), (1, 0, 2), (2, 0, 2), (None, None, 0)]
    kept = jaccard.first_of_groups(df.union(df.where("doc_id = 0")))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [0, None] and kept.columns == df.columns
    assert jaccard.choose_bands(0.8, 0.9999)[0] * math.log(1 - 0.8**5) <= math.log(1e-4)


# 3


def test_quality_edges_and_order(spark):
    df = docs_of(spark, [*EDGES, sentence(random.Random(1), 80), "a b c " * 40])
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert [got[i].n_words for i in range(8)] == [0, 0, 0, 1, 1, 1, 6, 0]
    assert got[6].n_repeat_words == 6 and got[9].n_repeat_words == 120
    assert got[8].kept and not got[9].kept and not got[0].kept
    assert quality.judge(df).where("kept").count() == 1
    assert quality.judge(df.limit(0)).count() == 0


def test_repeated_windows_despite_equal_hashes(spark):
    """Hashes of four bits: windows that differ share them, so the words decide."""
    rng = random.Random(4)
    texts = [sentence(rng, rng.randrange(120), 6) for _ in range(200)] + EDGES
    df = docs_of(spark, texts)
    weak, full = ({r.doc_id: r.n_repeat_words for r in quality.measured(df, hash_bits=n).collect()} for n in (4, 64))
    for i, t in enumerate(texts):
        w = [x for x in re.split("[ \t-\r]+", t or "") if x]
        times = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        n = len({k + j for k in range(len(w) - 2) if times[tuple(w[k : k + 3])] > 1 for j in range(3)})
        assert weak[i] == full[i] == n, t


def test_kept_rows_whatever_the_order(spark, monkeypatch):
    rng = random.Random(6)
    texts = [sentence(rng, 30 + k, 10 + 9 * k) + " !#" * (k % 37) for k in range(120)] + ["A" * 9 + sentence(rng, 60), "LOUD " * 80, *EDGES]
    df = docs_of(spark, texts).withColumn("n_words", F.lit("own"))
    want = sorted(r.doc_id for r in quality.judge(df.drop("n_words")).where("kept").collect())
    rules = list(quality.BASE_RULES + quality.CASCADE_RULES)
    for order in (rules, rules[::-1]):
        monkeypatch.setattr(quality, "in_order", lambda *_, order=order: order)
        got = quality.kept_rows(df)
        assert got.columns == df.columns and sorted((r.doc_id, r.n_words) for r in got.collect()) == [(k, "own") for k in want]
    monkeypatch.undo()
    assert sorted(r.doc_id for r in quality.kept_rows(df).collect()) == want and quality.kept_rows(df.limit(0)).count() == 0
    assert 20 < len(want) < len(texts) - 15


# 4


def test_rollup(spark):
    df = docs_of(spark, ["the cat sat", "the cat sat on the mat", None])
    counts = rollup.count_tokens(df, TOKENIZER, "v1")
    totals = rollup.Rollup.fresh(spark)
    for _ in range(2):  # the same batch again counts once
        totals.commit("one", rollup.inserts(counts))
    read = lambda: [tuple(r) for r in totals.totals().collect()]
    assert read() == [("s", "en", "v1", 3, 9)]
    totals.commit("two", rollup.deletes(counts.where("doc_id = 0")))
    after = counts.where("doc_id = 1").withColumn("n_tokens", F.lit(10))
    totals.commit("three", rollup.revisions(counts.where("doc_id = 1"), after))
    totals.commit("empty", rollup.inserts(counts.limit(0)))
    assert read() == [("s", "en", "v1", 2, 10)]
    totals.compact()
    assert read() == [("s", "en", "v1", 2, 10)] and not totals.commit("two", rollup.deletes(counts))
    assert totals.commit("it's/4", rollup.inserts(counts)) and totals.commit("it's/4", rollup.inserts(counts.limit(1)), replace=True)
    assert read() == [("s", "en", "v1", 3, 13)]
    assert rollup.Rollup.fresh(spark).totals().count() == 0


def test_rollup_query(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want[r.source, r.lang] += len(coder.encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang): r.n_tokens for r in queries.QUERIES["op4_token_rollup"](spark, SF).collect()}
    assert got == dict(want)


# 5


def families(spark, texts):
    got = collections.defaultdict(set)
    for r in licenses.scan(docs_of(spark, texts)).collect():
        got[r.doc_id].add(r.family)
    return [got[i] for i in range(len(texts))]


def wrapped(text, width, mark):
    return "\n".join(f"{mark}{line}" for line in textwrap.wrap(text, width))


def test_license_statements_wrapped_and_marked(spark):
    rng = random.Random(2)
    texts, want = [], []
    for k, (family, t) in enumerate(licenses.TEMPLATES):
        body = wrapped(t, 34, ["", "# ", " * ", "// "][k % 4])
        texts.append(f"{sentence(rng, 30)}\n{body}\n{sentence(rng, 30)}" if k % 2 else f"{sentence(rng, 30)}\n \n{body}\n#\n{sentence(rng, 30)}")
        want.append({family})
    assert families(spark, texts) == want


def test_licenses_told_apart(spark):
    rng = random.Random(3)
    cases = [
        (sentence(rng, 60), set()), ("in the use of the terms of the work", set()), ("We take all rights reserved seats.", set()),
        ("Those all rights reserved tables were full, so we left the file in the hall.", set()), (None, set()), ("", set()),
        ("All rights reserved. All rights reserved.", {"reserved"}), ("\n" * 40_000, set()),
        ("Licensed under the MIT license. \n" + "word " * 30 + "\nReleased under the Apache License 2.0.", {"mit", "apache-2.0"}),
        ("Licensed under the MIT license. Licensed under the BSD 3-Clause License.", {"mit", "bsd"}),
        ("Licensed under the Quokka License, version 7.", {"unknown"}), ("SPDX-License-Identifier: MIT", {"mit"}), ("// SPDX-License-Identifier: GPL-3.0-only", {"gpl-3.0"}),
    ]
    assert families(spark, [t for t, _ in cases]) == [w for _, w in cases]
    again = licenses.scan(docs_of(spark, ["The MIT License (MIT)"] * 3)).collect()
    assert sorted((r.doc_id, r.family) for r in again) == [(0, "mit"), (1, "mit"), (2, "mit")] and all(0 <= r.probability <= 1 for r in again)
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_license_model_is_held_out_and_kept(spark):
    table, intercepts, accuracy = licenses._trained(spark)
    assert accuracy > 0.88 and len(intercepts) == len(licenses.CLASSES)
    assert licenses._trained(spark)[0] is table


def test_license_passages_equal_a_plain_walk(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "x", ".", "\n", "\n\n", "\n#\n"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(120))) for _ in range(60)] + [None, "", "alpha beta " * 9]
    wanted = {("alpha", "beta"), ("gamma", "alpha"), ("¶", "gamma")}
    rows = spark.createDataFrame([(a, b) for a, b in wanted], "a string, b string").select(F.xxhash64("a", "b").alias("pair"))
    got = collections.Counter((r.doc_id, r.paragraph, r.at, r.passage) for r in licenses.passages(docs_of(spark, texts), rows).collect())
    want = collections.Counter()
    for i, t in enumerate(texts):
        for k, body in enumerate(re.split(r"\n[\W_]*\n", t or "")):
            marked = re.sub(r"[.!?;:]+(?=\s|$)", " ¶ ", body.lower())
            w = [x for x in re.split(r"[^\w¶]+", f"¶ {marked} ¶") if x]
            last, passage = None, 0
            for at in range(len(w) - 1):
                if (w[at], w[at + 1]) in wanted:
                    passage += last is not None and at - last > licenses.GAP
                    last = at
                    want[i, k, at, passage] += 1
    assert got == want


def test_license_scan_is_linear_in_a_line(spark):
    began = time.perf_counter()
    licenses.scan(docs_of(spark, ["some words of a line " * 1000])).count()
    middle = time.perf_counter()
    licenses.scan(docs_of(spark, ["some words of a line " * 40_000])).count()
    assert time.perf_counter() - middle < 10 + 3 * (middle - began)


# 6


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Example.NET/en/x?y"), (2, "http://example.net/de"), (3, None), (4, "no scheme"), (5, "x://org/fr/"), (6, "x://notnet/"), (7, "http://net?q"), (None, "http://a.example.com/de/#t"), (1, "HTTP://A.Example.NET/en/x?y")],
        "page_id long, url string",
    )
    rules = spark.createDataFrame(urls.RULES, "rule_host string, rule_path string, action string")
    got = [tuple(r) for r in urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").orderBy(F.col("page_id").asc_nulls_last()).collect()]
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de", "net/", "block"),
        (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "org", "/fr/", "org/fr/", "allow"), (6, "notnet", "/", None, "allow"), (7, "net", "", None, "allow"),
        (None, "a.example.com", "/de/", "example.com/de/", "block"),
    ]
    assert urls.judge(pages, rules.limit(0)).where("verdict = 'allow'").count() == 9
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_url_rules_of_many_shapes(spark, monkeypatch):
    """Rules of over a thousand shapes, ties, and the join by shuffle."""
    rules = [(f"{'a.' * (k % 40)}com", "/" + "x" * (k // 40), "block" if k % 2 else "allow") for k in range(1600)]
    rules += [("b.org", "/pq", "allow"), ("org", "/pq/r", "block"), ("t.net", "/", "allow"), ("t.net", "/", "block"), (None, "/", "block"), ("x.net", None, "block")]
    df = spark.createDataFrame(rules, "rule_host string, rule_path string, action string")
    pages = [(k, f"http://{'a.' * k}com/{'x' * 45}") for k in range(45)] + [(50, "http://q.b.org/pq/r"), (51, "x://T.net/"), (52, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string")

    def fits(host, path):
        found = [(-len(h + p), a != "block", h + p, a) for h, p, a in rules if h and p and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return min(found)[2:] if found else (None, "allow")

    for most in (0, 10**6):
        monkeypatch.setattr(urls, "BROADCAST_RULES", most)
        got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame, df).collect()}
        assert got == {k: fits(*((u or "x:///").split("://")[1].lower().split("/", 1)[0], "/" + (u or "x:///").split("://")[1].split("/", 1)[1])) for k, u in pages}


# 7


@pytest.mark.parametrize("max_chunks", [1_400_000, 300, 0])
def test_packing(spark, max_chunks):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(7)
    texts = [sentence(rng, rng.randrange(1, 900)) for _ in range(150)] + EDGES + ["<|endoftext|> İ Σς ½² １２ e\u0301 don't", "word " * 9000]
    ids = {i: coder.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    pieces = packing.pack(docs_of(spark, texts), TOKENIZER, max_chunks=max_chunks).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    for doc, parts in by_doc.items():
        parts.sort(key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist() == ids[doc]
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    assert set(by_doc) == set(ids)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        n = sum(p.length for p in parts)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 0.02 * sum(map(len, ids.values()))
    assert packing.pack(docs_of(spark, []), TOKENIZER).count() == 0


def test_nnls_conditions():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.random((8, 12)), rng.random(8)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-6).all() and (abs(slope[x > 1e-9]) < 1e-6).all()


# 8


def plain_model(texts):
    """Interpolated modified Kneser-Ney of order two by its definition: (P(w | v), the words, discounts)."""
    words = [[x for x in re.split("[ \t-\r]+", (t or "").lower()) if x] for t in texts]
    big = collections.Counter(p for w in words for p in zip(["<s>", *w], [*w, "</s>"]))

    def cuts(values):
        n = collections.Counter(values)
        return perplexity.discounts(n[1], n[2], n[3], n[4])

    high, cont = cuts(big.values()), collections.Counter(w for _, w in big)
    low = cuts(cont.values())
    total = sum(cont.values())
    unknown = sum(low[min(c, 3) - 1] for c in cont.values()) / total / (len(cont) + 1)
    single = lambda w: (cont[w] - low[min(cont[w], 3) - 1]) / total + unknown if w in cont else unknown
    seen, left = collections.Counter(), collections.Counter()
    for (v, _), c in big.items():
        seen[v] += c
        left[v] += high[min(c, 3) - 1]

    def p(v, w):
        if v not in seen:
            return single(w)
        c = big[v, w]
        return (c - high[min(c, 3) - 1] if c else 0) / seen[v] + left[v] / seen[v] * single(w)

    return p, cont, high


def test_discounts():
    # Y = 40 / (40 + 2 x 20) = 1/2, so 1 - 2 Y 20/40, 2 - 3 Y 10/20, 3 - 4 Y 5/10
    assert perplexity.discounts(40, 20, 10, 5) == (0.5, 1.25, 2.0)


@pytest.mark.parametrize(("head", "salt"), [(0, 10**9), (40, 300), (perplexity.HEAD, 10**9)])
def test_perplexity_equals_plain_model(spark, monkeypatch, head, salt):
    """Without a head, with one of some grams and many salts, and with all grams in it."""
    monkeypatch.setattr(perplexity, "HEAD", head)
    monkeypatch.setattr(perplexity, "SALT_CHARS", salt)
    monkeypatch.setattr(perplexity, "BLOCK_TOKENS", 1000)
    rng = random.Random(4)
    texts = [sentence(rng, 120, 40 + 3 * i) for i in range(60)] + [None, "", "tail " * 400, "Q q q zz!!"]
    df = docs_of(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    half = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).collect()}
    p, cont, high = plain_model([texts[i] for i in half])
    assert all(abs(sum(p(v, w) for w in cont) + p(v, "never") - 1) < 1e-9 for v in ("w1", "w77", "<s>")) and 0 < high[0] < 1
    got = {r.doc_id: r for r in perplexity.classify(df, trusted).collect()}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        if not w:
            assert got[i].perplexity is None and not got[i].kept
            continue
        logs = sum(math.log(p(a, b)) for a, b in zip(["<s>", *w], [*w, "</s>"]))
        assert got[i].perplexity == pytest.approx(math.exp(-logs / (len(w) + 1)), rel=1e-4)
    held = sorted(got[i].perplexity for i in range(60) if i not in half)
    assert got[0].threshold == held[math.ceil(0.99 * len(held)) - 1] and not got[63].kept


def test_perplexity_edges(spark):
    df = docs_of(spark, ["a b", "a b"]).withColumn("lang", F.lit(None).cast("string"))
    got = perplexity.classify(df, spark.createDataFrame([], "doc_id long")).collect()
    assert len(got) == 2 and all(r.kept for r in got)
    assert perplexity.classify(df.limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


# 9


def base_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(6)
    parts = ["token: ", "password=", "ApiKey = '", "api_key:", "abcdefghijkl", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMN0123", " ", "é😀", "\n", "=", "short", "secret", '"']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + EDGES
    versions = secrets.versions_of(docs_of(spark, texts))
    ledger = secrets.scan_unseen(versions)
    got = {r.path: [(s["start"], s["rank"], s["rule"], s["end"]) for s in (r.findings or [])] for r in secrets.findings_by_path(versions, ledger).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 3] == base_secrets(t or ""), t


@pytest.mark.parametrize("most", [0, secrets.BROADCAST_BLOBS])
def test_ledger_is_incremental(spark, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_BLOBS", most)
    versions = secrets.versions_of(docs_of(spark, ["x token: abcdefghijklmnop", "x token: abcdefghijklmnop", "clean"]))
    first = secrets.scan_unseen(versions, secrets.Ledger.fresh(spark).scans.read())
    assert first.count() == 2
    more = secrets.versions_of(docs_of(spark, ["x token: abcdefghijklmnop", "new"]))
    second = secrets.scan_unseen(more, first)
    assert second.count() == 1
    newer = (*secrets.RULES, secrets.SecretRule("word", 1, "new"))
    third = secrets.scan_unseen(more, first.union(second), newer)
    assert {tuple(r.scanned) for r in third.collect()} == {("word@1",)}
    found = secrets.findings_by_path(more, first.union(second).union(third))
    assert {r.path: secrets_of(r) for r in found.collect()} == {0: ["assign"], 1: ["word"]}
    assert secrets.scan_unseen(versions.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, secrets.BROADCAST_BLOBS])
def test_scan_of_copies_and_null_paths(spark, monkeypatch, most):
    """Copies over paths, of a path, and of no path are scanned once, whichever way their ids meet them."""
    monkeypatch.setattr(secrets, "BROADCAST_BLOBS", most)
    one, two, three = (f"token: abcdefghijkl{k}" for k in range(3))
    rows = [(1, one), (2, one), (2, one), (3, two), (None, two), (None, three), (4, None), (None, ""), (None, "x"), (None, "x")]
    versions = secrets.versions_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    scans = secrets.scan_unseen(versions)
    assert scans.count() == 5 and all(len(r.scanned) == len(secrets.RULES) for r in scans.collect())
    found = secrets.findings_by_path(versions, scans).collect()
    assert len(found) == len(rows) and sum(secrets_of(r) == ["assign"] for r in found) == 6


def test_lone_blobs_stay_where_they_lie(spark):
    versions = secrets.versions_of(docs_of(spark, ["x token: abcdefghijklmnop", "a", "a", "clean"]))
    plan = secrets.scan_unseen(versions)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "LeftOuter" in joins[0] and "strategy=broadcast" in joins[0]


@pytest.mark.parametrize("most", [0, secrets.BROADCAST_BLOBS])
def test_ledger_commits(spark, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_BLOBS", most)
    ledger = secrets.Ledger.fresh(spark)
    first = secrets.versions_of(docs_of(spark, ["x token: abcdefghijklmnop", "x token: abcdefghijklmnop", "clean", None]))
    assert ledger.findings().count() == 0
    assert ledger.commit("a/b 'c'", first) == 3 and ledger.commit("a/b 'c'", first) == 0
    again = secrets.versions_of(docs_of(spark, ["clean", "0123456789abcdef"] * 3 + [""]))
    assert ledger.commit("second", again) == 1
    found = [(r.path, secrets_of(r)) for r in ledger.findings().collect()]
    assert len(found) == 4 + 7 and sorted(k for k, v in found if v) == [0, 1, 1, 3, 5]
    upgraded = secrets.Ledger(ledger.versions, ledger.scans, (*secrets.RULES, secrets.SecretRule("word", 1, "clean")))
    assert upgraded.commit("second", again) == 3
    assert sum("word" in secrets_of(r) for r in upgraded.findings().collect()) == 4


def test_secrets_query_on_the_table(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    names = list(secrets.BASE)
    got = queries.QUERIES["op9_secrets"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        spans = base_secrets(text[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, _, e in spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _, _ in spans) for i in range(3)]


def test_further_secrets(spark):
    """The rules beyond the base ones against the same patterns in Python, over many matches in one text."""
    pem = "-----BEGIN RSA PRIVATE KEY-----"
    parts = [pem, "ghp_" + "a1B2" * 9, "xoxb-1234567890-abc", "eyJhbGciOiJ9.eyJzdWIiOiIx.c2lnbmF0dXJl", "gh_x", "word", "é", "\n"]
    rng = random.Random(8)
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 5, 2500, 5001)]
    found = secrets.findings_by_path(versions := secrets.versions_of(docs_of(spark, texts)), secrets.scan_unseen(versions))
    got = {r.path: [(s["start"], s["rule"], s["end"]) for s in (r.findings or []) if s["rank"] > 2] for r in found.collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), r.name, m.end()) for r in secrets.RULES[3:] for m in re.finditer(r.pattern, t)]
        assert got[i] == sorted(want)


def secrets_of(row):
    return [s["rule"] for s in row.findings or []]


# 10


def test_decontamination(spark):
    rng = random.Random(9)
    items = [sentence(rng, n, 3000) for n in (20, 37, 60, 60)] + ["too short", None]
    swapped = items[2].split()
    swapped = " ".join(swapped[30:] + swapped[:30])
    changed = items[3].split()
    changed[1] = "changed"
    texts = [
        f"{sentence(rng, 30)} {items[0]} {sentence(rng, 30)}", items[1].upper(), f"{sentence(rng, 9)} {swapped}", " ".join(changed), sentence(rng, 200, 3000),
        " ".join(items[1].split()[:20]) + " " + sentence(rng, 30), *EDGES, f"{items[0]} {items[2]}",
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")

    def shingles(t):
        w = [x for x in re.split("[ \t-\r]+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for i, t in enumerate(texts):
        d = shingles(t)
        for j, item in enumerate(items):
            b = shingles(item)
            for at in range(max(1, len(d) - len(b) + 1)) if b and d else ():
                a = collections.Counter(d[at : at + len(b)])
                both = sum((a & collections.Counter(b)).values())
                s = both / (sum(a.values()) + len(b) - both)
                if s >= 0.8:
                    want[i, j] = max(s, want.get((i, j), 0))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs_of(spark, texts), bench, ["doc_id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (14, 0), (14, 2)} == set(want)
    clean = decontaminate.clean(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(texts)) if i not in {k for k, _ in want}]
    assert decontaminate.leaks(docs_of(spark, []), bench, ["doc_id"]).count() == 0
    assert decontaminate.leaks(docs_of(spark, texts), bench.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_many_items_and_long_texts(spark, monkeypatch, most):
    """Tables of the benchmark joined by shuffle and by broadcast; items across the borders of chunks."""
    rng = random.Random(10)
    items = [sentence(rng, 20 + k, 3000) for k in range(7)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", most)
    monkeypatch.setattr(decontaminate, "CHUNK", 40)
    padded = [f"{sentence(rng, 13 * k, 3000)} {t}{' tail' * (k % 3)}" for k, t in enumerate(items)]
    got = decontaminate.leaks(docs_of(spark, padded), bench, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id, r.word_start, r.similarity) for r in got) == [(i, i, 13 * i, 1.0) for i in range(7)]


@pytest.mark.parametrize("n", [13, 17, 25])
def test_few_distinct_shingles(spark, n):
    """Alternating words: two shingles outweigh all others, so fingerprints say nothing."""
    items = [" ".join(f"a{k}" if i % 2 else f"b{k}" for i in range(n)) for k in range(200)]
    texts = [" ".join(f"b{k}" if i % 2 else f"a{k}" for i in range(n)) for k in range(200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.leaks(docs_of(spark, texts), bench, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(200)]


def test_edited_items_are_found(spark):
    """Items of many lengths with as many words changed as similarity 0.8 allows, one part repeated."""
    rng = random.Random(12)
    items, texts = [], []
    for k in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(13, 120))]
        m = len(w) - 4
        spare = (2 * m - int(np.ceil(2 * m * 0.8 / 1.8))) - m  # shingles that may differ
        cut_off = [*w[spare:], *(["the"] * spare if k % 2 else [f"n{rng.randrange(10**6)}" for _ in range(spare)])]
        items.append(" ".join(w))
        texts.append(" ".join(cut_off))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.leaks(docs_of(spark, texts), bench, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(300)]
    assert any(r.similarity < 0.82 for r in got)


def test_simhash_lanes(spark):
    rng = random.Random(3)
    arrays = [[rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (0, 1, 2, 50, 333, 40_000)]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(arrays)], "k int, a array<long>")
    got = [r.f & (2**64 - 1) for r in df.orderBy("k").select(F.expr(decontaminate.simhash("a")).alias("f")).collect()]
    assert got == [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in a) > len(a)) for a in arrays]


def test_multi_index_covers_the_radius():
    rng = random.Random(1)
    near = set(decontaminate._near_values())
    for _ in range(2000):
        bits = sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS))
        assert any((bits >> (8 * k)) & 255 in near for k in range(8))


def test_results_are_plain(spark):
    for name, f in queries.QUERIES.items():
        if name in ("op6_url_filter", "op7_packing"):
            assert json.dumps(f(spark, SF).limit(1).toPandas().astype(str).to_dict("records")) is not None
