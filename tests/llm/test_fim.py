"""Fill-in-middle against a plain version, the lists against plain lists."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chalkline.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, digest string, keys string"


def plain(key, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (key, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return (key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=300), st.integers(0, 5000))
def test_list_selects_each_place(steps, rest):
    values = np.cumsum(steps)
    made = fim.elias_fano(values, int(values[-1]) + rest)
    assert [fim.select(k, *made) for k in range(len(values))] == values.tolist()
    assert sum(map(len, made[1:])) <= len(values) * (2 + max(0, np.log2((values[-1] + rest + 1) / len(values)))) / 8 * 1.5 + 16


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ <PSM>\n.é\U0001f600́\x00", max_size=60))
def test_boundaries_are_those_of_the_pattern(text):
    raw = text.encode()
    ends = np.cumsum([len(t.encode()) for t in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)]).tolist()
    assert fim.boundaries(raw).tolist() == [0, *ends]


def texts_of(rng):
    edges = [None, "", " ", "a", "ab\ncd", "x" * 100_000, "a<P>b", "<", "<<P", "<S", "S>", "é\U0001f600 ß", "\n" * 900, "a<", "<M<S<P", "a\x00b"]
    return edges + ["".join(rng.choice(["w", "Wort", " ", ".", "<", "P", ">", "é", "\n"]) for _ in range(rng.randrange(80))) for _ in range(150)]


@pytest.mark.parametrize("rows", [2, 64])
def test_documents_equal_plain(spark, rows):
    rng = random.Random(11)
    texts = texts_of(rng)
    made = [(k, t, None, None, "clash", "clash") for k, t in enumerate(texts)]
    made += [(10_000 + k, "the same text again, one of very many", 1, "x", "y", "z") for k in range(700)]
    made += [(None, "null key", 1, "x", "y", "z"), (3, "a", 1, "x", "y", "z"), (3, "a", 1, "x", "y", "z")]
    rng.shuffle(made)
    docs = spark.createDataFrame(made, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = fim.fill_in_middle(docs).withColumn("back", fim.restored()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plain(r[0], r[1]) for r in made), key=repr)
    of = {}
    for r in made:
        of.setdefault(r[0], r[1] or "")
    assert all(r.back == of[r.doc_id] for r in got if r.doc_id != 3) and len({r.form for r in got}) == 3


def test_index_folds_copies(spark):
    docs = spark.createDataFrame([(k, "copy") for k in range(4000)] + [(5000 + k, f"text {k}") for k in range(50)], "doc_id long, text string").repartition(4)
    found = fim.index(docs).collect()
    assert sum(len(r["keys"]) for r in found) == 4050 and sum(r.text == "copy" for r in found) <= 8
    assert len({r.text for r in found}) == 51 and all(r.n == 3 for r in found if r.text != "copy" and len(r.text) == 6)


def test_equal_digests_do_not_join_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"digest": [b"same"] * 3, "slot": [0] * 3, "text": ["a b", "c", "a b"], "keys": [[1], [2], [3]]})
    (out,) = fim._listed([batch])
    assert out.column("n").to_pylist() == [3, 1, 3]


def test_empty_table_and_other_keys(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    got = fim.fill_in_middle(spark.createDataFrame([("k1", "one two three")], "name string, body string"), "name", "body").first()
    assert tuple(got) == plain("k1", "one two three")
