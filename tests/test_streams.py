"""Streams with order and timers against plain folds, over random arrival orders and micro-batches."""

import datetime
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from chalkline.sources import channel
from chalkline.streaming import conflate, joins, numbering, ordering, pairs

T0 = 1_700_000_000_000


def fed(spark, tmp_path, name, batches, schema):
    """A stream that reads one file for each of ``batches``, one a micro-batch."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
        (part,) = (tmp_path / f"{name}-{k}").glob("part-*.parquet")
        folder.mkdir(exist_ok=True)
        part.rename(folder / f"{k:05d}.parquet")
        os.utime(folder / f"{k:05d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(stream, tmp_path, name, endless=0):
    """All rows of a stream over what is there; ``endless``: it never ends, but is through after so many input rows."""
    out, check = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check")
    q = stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
    began = time.monotonic()
    while q.isActive and time.monotonic() - began < 120:
        rows = [p["numInputRows"] for p in q.recentProgress]
        if endless and sum(rows) >= endless and rows[-1] == 0:  # state with a time to live lets a query go on for ever
            break
        time.sleep(0.1)
    if q.exception():
        raise q.exception()
    assert endless or not q.isActive, name
    q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).collect()


def stamped(rows, at):
    """``rows`` with milliseconds at place ``at`` as timestamps."""
    time_of = lambda ms: None if ms is None else datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC)
    return [(*r[:at], time_of(r[at]), *r[at + 1 :]) for r in rows]


# Ordered emission

PACKET = "session_id string, ord long, sequence long, text string, at timestamp"


def arrivals(rng, sessions=4, n=40, shift=9, lost=0.1):
    """Packets that come at most ``shift`` seconds of event time late, with some numbers lost."""
    out = []
    for s in range(sessions):
        for k in range(1, n + 1):
            if rng.random() > lost:
                out.append((f"s{s}", k, f"text {k}", T0 + k * 1000, T0 + k * 1000 + rng.randrange(shift * 1000)))
    out.sort(key=lambda r: r[4])
    return [(s, i, k, t, at) for i, (s, k, t, at, _) in enumerate(out)]


def plain_emission(rows, delay, first=1):
    """Each step: take the packet; then whatever may leave, smallest number first, by trying them all."""
    out, of = [], {}
    for s, _, k, t, at in sorted(rows, key=lambda r: r[1]):
        state = of.setdefault(s, {"wait": {}, "passed": first - 1, "n": 0, "mark": None})

        def leave(to, s=s, state=state):
            while state["wait"]:
                k = min(state["wait"])
                forced = [q for q, (_, a) in state["wait"].items() if to is None or (to is not False and a <= to)]
                if k != state["passed"] + 1 and not forced:
                    return
                text, _ = state["wait"].pop(k)
                state["n"], state["passed"] = state["n"] + 1, k
                out.append((s, state["n"], k, text, False))

        if k <= state["passed"] or k in state["wait"]:
            out.append((s, None, k, t, True))
        else:
            state["wait"][k] = (t, at)
        leave(False)
        state["mark"] = max(at, state["mark"] or at)
        leave(state["mark"] - delay)
    for s, state in of.items():
        while state["wait"]:
            k = min(state["wait"])
            text, _ = state["wait"].pop(k)
            state["n"] += 1
            out.append((s, state["n"], k, text, False))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "shift", "delay"), [(1, 9, 9000), (2, 9, 3000), (3, 20, 1000), (4, 1, 0)])
def test_order_in_batch(spark, seed, shift, delay):
    rng = random.Random(seed)
    rows = arrivals(rng, shift=shift)
    rows += [(s, 10_000 + i, k, "again", at) for i, (s, _, k, _, at) in enumerate(rng.sample(rows, 5))] + [(None, 1, 1, "x", T0), ("s0", 2, None, "x", T0), ("s0", 3, 77, "x", None)]
    got = ordering.in_order(spark.createDataFrame(stamped(rows, 4), PACKET), delay).collect()
    assert sorted(map(tuple, got), key=repr) == plain_emission([r for r in rows if None not in r], delay)
    if delay >= shift * 1000:
        assert sum(r.late for r in got) == 5


def test_order_in_stream_is_sorted_for_any_arrival_within_the_delay(spark, tmp_path):
    rng = random.Random(6)
    rows = arrivals(rng, sessions=3, n=30, shift=8)
    batches = [rows[i : i + 17] for i in range(0, len(rows), 17)]
    batches += [[("clock", 0, 2, "later", T0 + 10_000_000)], [("clock", 0, 3, "later", T0 + 20_000_000)]]
    stream = ordering.in_order_stream(fed(spark, tmp_path, "packets", [stamped(b, 4) for b in batches], PACKET), "9 seconds")
    got = [r for r in drained(stream, tmp_path, "order") if r.session_id != "clock"]
    assert not any(r.late for r in got)
    for s in {r[0] for r in rows}:
        want = sorted((r[2], r[3]) for r in rows if r[0] == s)
        mine = sorted((r.place, r.sequence, r.text) for r in got if r.session_id == s)
        assert [(k, t) for _, k, t in mine] == want and [p for p, _, _ in mine] == list(range(1, len(want) + 1))


def test_late_packets_are_given_as_late(spark, tmp_path):
    batches = [[("s", 1, 1, "a", T0), ("s", 2, 3, "c", T0 + 1000)], [("t", 1, 1, "clock", T0 + 60_000)], [("t", 1, 2, "clock", T0 + 61_000)], [("s", 3, 2, "b", T0 + 59_000), ("s", 4, 4, "d", T0 + 61_000)], [("t", 1, 3, "clock", T0 + 200_000)]]
    stream = ordering.in_order_stream(fed(spark, tmp_path, "late", [stamped(b, 4) for b in batches], PACKET), "5 seconds")
    got = sorted((r.sequence, r.place, r.late) for r in drained(stream, tmp_path, "late") if r.session_id == "s")
    assert got == [(1, 1, False), (2, None, True), (3, 2, False), (4, 3, False)]


def test_empty_order(spark):
    assert ordering.in_order(spark.createDataFrame([], PACKET), 1000).count() == 0


# JSON pairs

DELTA = "item_id string, ord long, delta string"


def value(rng, depth=0):
    kind = rng.randrange(8)
    if kind < 4:
        return "".join(rng.choice('ab"\\é\n/{}[],: \U0001f600') for _ in range(rng.randrange(7)))
    if kind == 4:
        return rng.choice([1, -2.5, True, None])
    if kind == 5 and depth < 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == 6 and depth < 3:
        return {rng.choice(["k", '"', "\\"]) * k: value(rng, depth + 1) for k in range(rng.randrange(3))}
    return "plain"


def items(rng, n):
    made, rows = {}, []
    for i in range(n):
        whole = {rng.choice(["en", "ko", '"', "\\"]) + str(k): value(rng) for k in range(rng.randrange(5))}
        text, at, k = json.dumps(whole, ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (" , ", " : ")])), 0, 0
        made[f"i{i}"] = (whole, text)
        while at < len(text):
            width = rng.randrange(1, 9)
            rows.append((f"i{i}", k, text[at : at + width]))
            at, k = at + width, k + 1
    return made, rows


def same(got, made):
    for i, (whole, _) in made.items():
        mine = [(r.name, r.value) for r in sorted((r for r in got if r.item_id == i), key=lambda r: r.ord)]
        assert dict(mine).keys() == whole.keys() and len(mine) == len(whole)
        assert all(v == whole[k] if isinstance(whole[k], str) or v is None else json.loads(v) == whole[k] for k, v in mine)


def closed_at(text, deltas, name):
    """The first delta with which the text so far, made whole, has the member: tried for each."""
    sofar = ""
    for k, d in deltas:
        sofar += d
        for end in ("", "}"):
            try:
                if name in json.loads(sofar + end):
                    return k
            except ValueError:
                pass


def test_pairs_equal_whole_text_for_any_cut(spark):
    rng = random.Random(8)
    made, rows = items(rng, 300)
    same(pairs.pairs(spark.createDataFrame(rows, DELTA)).collect(), made)


def test_strings_close_at_their_delta(spark):
    texts = {"a": '{"en":"one","ko":"t\\"wo","ja":"three"}', "b": '{"x":"1"}'}
    rows = [(i, k, c) for i, t in texts.items() for k, c in enumerate(t)]
    for r in pairs.pairs(spark.createDataFrame(rows, DELTA)).collect():
        assert r.ord == closed_at(texts[r.item_id], [(k, c) for i, k, c in rows if i == r.item_id], r.name)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":"x","b":1,"c":"y"}', [("a", "x")]), ('{"a":"x","a":"y"}', [("a", "x")]), ('["a"]', []), ('{"a":"x" "b":"y"}', [("a", "x")]), ('{"a":"x","d":"y"', [("a", "x")]),
        ('{"a":"bad \\x"}', []), ("", []), ('{}{"a":"x"}', []), (' {"a" : "x" }', [("a", "x")]), ('{"a":"cut', []),
    ],
)
def test_wanted_strings_only(spark, text, want):
    rows = [("i", k, c) for k, c in enumerate(text)] + [("i", 900, None), (None, 1, "{")]
    got = pairs.pairs(spark.createDataFrame(rows, DELTA), names=("a", "b", "c"), strings_only=True).collect()
    assert [(r.name, r.value) for r in got] == want


def test_pairs_in_stream(spark, tmp_path):
    rng = random.Random(4)
    made, rows = items(rng, 12)
    rows.sort(key=lambda r: (r[1], r[0]))
    batches = [rows[i : i + 1 + len(rows) // 6] for i in range(0, len(rows), 1 + len(rows) // 6)]
    same(drained(pairs.pairs_stream(fed(spark, tmp_path, "deltas", batches, DELTA)), tmp_path, "pairs"), made)


# Conflated requests

PARTIAL = "session_id string, ord long, kind string, text string, at timestamp, takes_ms long"


def plain_conflation(rows, interval, least):
    """Millisecond by millisecond."""
    out = []
    for s in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[4], r[1]))
        newest = asked = began = flying = None
        takes, number = 0, 0
        for now in range(T0, T0 + 400):
            def act():
                nonlocal newest, asked, began, flying, number
                if flying and flying[1] <= now:
                    out.append((s, number, flying[0], began, now))
                    flying = None
                if not flying and newest is not None and newest != asked and (began is None or now >= began + interval):
                    number, began, asked, flying = number + 1, now, newest, (newest, now + takes)
                    if takes == 0:
                        act()

            act()
            for _, _, kind, text, at, wait in mine:
                if at == now:
                    if kind == "final":
                        newest = asked = began = flying = None
                    elif len(text.strip()) >= least:
                        newest, takes = text.strip(), wait
                        act()
    return sorted(out)


def partials(rng, sessions=3, n=25):
    rows = []
    for s in range(sessions):
        at = T0
        for k in range(n):
            at += rng.choice([0, 1, 3, 7, 15])
            rows.append((f"s{s}", k, "final" if rng.random() < 0.15 else "partial", rng.choice(["aa", "bbb", "cccc", "x", f"t{k}"]), at, rng.choice([0, 2, 9, 20])))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_conflated_equals_the_clock(spark, seed):
    rows = partials(random.Random(seed))
    rules = conflate.Throttle(interval_ms=10, min_chars=2)
    got = conflate.conflated(spark.createDataFrame(stamped(rows, 4), PARTIAL), rules).collect()
    assert sorted(map(tuple, got)) == plain_conflation(rows, 10, 2)


def test_conflated_stream_equals_batch(spark, tmp_path):
    rows = sorted(partials(random.Random(31)), key=lambda r: (r[4], r[0], r[1]))
    rules = conflate.Throttle(interval_ms=10, min_chars=2)
    batches = [rows[i : i + 20] for i in range(0, len(rows), 20)] + [[("clock", 0, "final", None, T0 + 10**6, 0)], [("clock", 1, "final", None, T0 + 2 * 10**6, 0)]]
    stream = conflate.conflated_stream(fed(spark, tmp_path, "partials", [stamped(b, 4) for b in batches], PARTIAL), rules, "0 seconds")
    want = conflate.conflated(spark.createDataFrame(stamped(rows, 4), PARTIAL), rules).collect()
    assert sorted(map(tuple, drained(stream, tmp_path, "conflated"))) == sorted(map(tuple, want))


# Stream-stream join

CAPTION = "segment_id string, locale string, at timestamp, text string"
SOUND = "segment_id string, locale string, published_at timestamp, sound_ms long"


def test_captions_meet_their_sound(spark, tmp_path):
    rng = random.Random(2)
    captions = [(f"g{k}", rng.choice(["en", "ko"]), T0 + k * 1000, f"text {k}") for k in range(60)] + [(None, "en", T0, "no segment")]
    sounds = [(s, l, at + rng.choice([-500, 0, 4000, 10_000, 10_001]), 7) for s, l, at, _ in captions if s and rng.random() < 0.7]
    want = []
    for s, l, at, t in captions:
        hits = [x for x in sounds if s is not None and x[0] == s and x[1] == l and at <= x[2] <= at + 10_000]
        want += [(s, t, x[3], x[2] - at) for x in hits] or [(s, t, None, None)]
    want = sorted(want, key=repr)
    batch = joins.captions_with_audio(spark.createDataFrame(stamped(captions, 2), CAPTION), spark.createDataFrame(stamped(sounds, 2), SOUND), "10 seconds")
    key = lambda r: (r.segment_id, r.text, r.sound_ms, r.audio_after_ms)
    assert sorted(map(key, batch.collect()), key=repr) == want
    flush = T0 + 10**8
    left = fed(spark, tmp_path, "captions", [stamped(captions[i : i + 20], 2) for i in range(0, 61, 20)] + [stamped([("z", "z", flush, "z")], 2), stamped([("z", "z", flush + 10**7, "z")], 2)], CAPTION)
    right = fed(spark, tmp_path, "sounds", [stamped(sounds[i : i + 15], 2) for i in range(0, len(sounds), 15)] + [stamped([("y", "y", flush, 1)], 2), stamped([("y", "y", flush + 10**7, 1)], 2)], SOUND)
    got = [r for r in drained(joins.captions_with_audio(left, right, "10 seconds", "60 seconds"), tmp_path, "joined") if r.segment_id != "z"]
    assert sorted(map(key, got), key=repr) == want


# Numbers after a restart

SEGMENT = "session_id string, ord long, text string"


def test_numbers_go_on_after_a_restart(spark, tmp_path):
    first = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "none")]
    made = drained(numbering.numbered_stream(fed(spark, tmp_path, "n1", [first[:2], first[2:]], SEGMENT), "r1"), tmp_path, "n1", endless=3)
    assert sorted((r.session_id, r.sequence, r.segment_id) for r in made) == [("a", 1, "a-r1-seg-000001"), ("a", 2, "a-r1-seg-000002"), ("b", 1, "b-r1-seg-000001")]
    left = numbering.last_numbers(spark, str(tmp_path / "n1-check"))
    assert sorted((r.session_id, r.sequence) for r in left.collect()) == [("a", 2), ("b", 1)]
    again = numbering.numbered_stream(fed(spark, tmp_path, "n2", [[("a", 9, "w"), ("c", 1, "v")]], SEGMENT), "r2", left)
    assert sorted((r.session_id, r.sequence, r.segment_id) for r in drained(again, tmp_path, "n2", endless=2)) == [("a", 3, "a-r2-seg-000003"), ("c", 1, "c-r2-seg-000001")]


# Channels


def test_channel_gives_each_message_once(spark, tmp_path):
    kind, path = channel.register(spark), str(tmp_path / "channel")
    assert spark.read.format(kind).option("path", path).load().count() == 0
    rows = [("started", f"k{k}", f'line\n"{k}" é') for k in range(50)] + [("ended", None, None)]
    batches = [[(t, k, v) for t, k, v in rows[i : i + 13]] for i in range(0, len(rows), 13)]
    source = fed(spark, tmp_path, "messages", batches, channel.MESSAGE)

    def publish(check):
        q = source.writeStream.format(kind).option("path", path).option("writer", "w1").option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    publish("c1")
    publish("c2")  # the same batches by a query that lost its checkpoint: each is there already
    spark.createDataFrame([("started", "other", "batch")], channel.MESSAGE).write.format(kind).option("path", path).mode("append").save()
    (tmp_path / "channel" / "messages" / "w1-of-a-task-that-died.jsonl").write_text('["started", "dead", "x"]\n')
    want = sorted([*rows, ("started", "other", "batch")], key=repr)
    all_ = spark.read.format(kind).option("path", path).load()
    assert sorted(((r.topic, r.key, r.value) for r in all_.collect()), key=repr) == want
    assert all_.select("writer", "batch", "file", "line").distinct().count() == len(want)
    assert spark.read.format(kind).option("path", path).option("topic", "ended").load().collect()[0].value is None

    read = lambda: spark.readStream.format(kind).option("path", path).load()
    out, check = str(tmp_path / "read"), str(tmp_path / "read-check")

    def consume():
        q = read().writeStream.format("parquet").option("checkpointLocation", check).trigger(processingTime="0 seconds").start(out)
        began = time.monotonic()
        while not any(p["numInputRows"] for p in q.recentProgress) and time.monotonic() - began < 60:
            time.sleep(0.2)
        q.processAllAvailable()
        q.stop()  # in the middle of its life
        return sorted(((r.topic, r.key, r.value) for r in spark.read.parquet(out).collect()), key=repr)

    assert consume() == want
    spark.createDataFrame([("ended", "new", "y")], channel.MESSAGE).write.format(kind).option("path", path).mode("append").save()
    assert consume() == sorted([*want, ("ended", "new", "y")], key=repr)


def test_channel_commits_once(tmp_path):
    folder = channel._Folder({"path": str(tmp_path), "writer": "w"})
    first, second = folder._write([{"topic": "t", "key": "k", "value": "1"}]), folder._write([{"topic": "t", "key": "k", "value": "1"}])
    folder._commit([first, None], 0)
    folder._commit([second], 0)
    assert [p.name for p in folder._parts({}, folder._committed())] == [first.name] and len(list((tmp_path / "messages").iterdir())) == 1
    folder._commit([folder._write([])], 1)
    assert folder._committed() == {"w": 2} and folder._parts({"w": 1}, {"w": 2}) == []
