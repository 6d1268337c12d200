"""Lanes of jobs against a plain clock that looks at every millisecond; batch and stream alike."""

import random

import pytest

from chalkline.streaming import lanes
from tests.test_streams import T0, drained, fed, stamped

JOB = "session_id string, ord long, kind string, locales array<string>, at timestamp, takes_ms long"
LOCALES = ("en", "ja")


def jobs_of(seed):
    """Jobs of three sessions over some 400 ms, with ends, equal times, unknown and repeated locales; more for even seeds."""
    rng, out = random.Random(seed), []
    for k in range(60 if seed % 2 else 250):
        kind = "end" if rng.random() < 0.06 else rng.choice(["job", "job", None])
        wanted = rng.choice([["en"], ["ja"], ["en", "ja"], ["en", "en"], ["xx", "ja"], [], [None, "en"], None])
        out.append((f"s{rng.randrange(3)}", k, kind, wanted, T0 + rng.randrange(400), rng.choice([None, -3, 0, 1, 5, 20, 60])))
    return sorted(out, key=lambda r: (r[4], r[1]))


def plain_clock(rows, rules):
    """Every lane by itself: each millisecond first what ends, then what arrives, then what is taken."""
    out = [(s, x, k, "unsupported", at, None, None) for s, k, kind, ls, at, _ in rows if kind != "end" for x in dict.fromkeys(ls or []) if x and x not in rules.locales]
    for s in {r[0] for r in rows}:
        for x in rules.locales:
            mine = [r for r in rows if r[0] == s and (r[2] == "end" or x in (r[3] or []))]
            queue, work, shut, gone = [], None, None, None  # shut: deadline of an end; gone: jobs before it are refused
            for now in range(T0, T0 + 20_000):
                if work and work[3] <= now:
                    out.append((s, x, work[0], "played", work[1], work[2], work[3]))
                    work = None
                for _, k, kind, _, at, takes in (r for r in mine if r[4] == now):
                    if kind == "end":
                        # what the lane does until the deadline, without any row
                        deadline, last = now + rules.flush_ms, now
                        clock = now
                        while clock <= deadline and (work or queue):
                            if work and work[3] <= clock:
                                out.append((s, x, work[0], "played", work[1], work[2], work[3]))
                                last, work = max(last, work[3]), None
                            while not work and queue:
                                job = queue.pop(0)
                                if rules.most_wait_ms and clock - job[1] > rules.most_wait_ms and queue:
                                    out.append((s, x, job[0], "skipped", job[1], None, None))
                                    continue
                                work = (job[0], job[1], clock, clock + job[2])
                                if work[3] <= clock:
                                    out.append((s, x, work[0], "played", work[1], work[2], work[3]))
                                    last, work = max(last, work[3]), None
                            clock += 1
                        if work or queue:
                            last = deadline
                            if work:
                                out.append((s, x, work[0], "discarded", work[1], work[2], None))
                            out += [(s, x, j[0], "discarded", j[1], None, None) for j in queue]
                        queue, work = [], None
                        gone = max(last, gone or last)
                        shut = max(last, shut or 0)
                    elif gone is not None and at < gone:
                        out.append((s, x, k, "refused", at, None, None))
                    else:
                        queue.append((k, at, max(takes or 0, 0)))
                while not work and queue and now >= (shut or 0):
                    job = queue.pop(0)
                    if rules.most_wait_ms and now - job[1] > rules.most_wait_ms and queue:
                        out.append((s, x, job[0], "skipped", job[1], None, None))
                        continue
                    work = (job[0], job[1], now, now + job[2])
                    if work[3] <= now:
                        out.append((s, x, work[0], "played", work[1], work[2], work[3]))
                        work = None
    return sorted(out, key=repr)


SEEDS = [(1, 30, 25), (2, 0, 25), (3, 30, 0), (4, 5, 200), (5, 1, 1)]


def test_the_jobs_meet_every_status():
    met = {r[3] for seed, wait, flush in SEEDS for r in plain_clock(jobs_of(seed), lanes.Lanes(LOCALES, wait, flush))}
    assert met == {"played", "skipped", "discarded", "refused", "unsupported"}


@pytest.mark.parametrize(("seed", "wait", "flush"), SEEDS)
def test_batch(spark, seed, wait, flush):
    rows, rules = jobs_of(seed), lanes.Lanes(LOCALES, wait, flush)
    more = [(None, 900, "job", ["en"], T0, 1), ("s0", 901, "job", ["en"], None, 1)]
    got = lanes.worked_off(spark.createDataFrame(stamped(rows + more, 4), JOB), rules).collect()
    assert sorted(map(tuple, got), key=repr) == plain_clock(rows, rules)


def test_empty_and_ties(spark):
    rules = lanes.Lanes(LOCALES, 2, 10)
    assert lanes.worked_off(spark.createDataFrame([], JOB), rules).count() == 0
    rows = [("s", k, "job", ["en"], T0, 5) for k in range(4)]
    got = {r.ord: (r.status, r.started_ms) for r in lanes.worked_off(spark.createDataFrame(stamped(rows, 4), JOB), rules).collect()}
    assert got == {0: ("played", T0), 1: ("skipped", None), 2: ("skipped", None), 3: ("played", T0 + 5)}


def test_stream_is_the_batch(spark, tmp_path):
    """Micro-batches that cut sessions anywhere; a last job far ahead moves the watermark past all timers."""
    rules = lanes.Lanes(LOCALES, 30, 25)
    rows = jobs_of(6)
    last = [("z", 1000, "job", ["en"], T0 + 10_000_000, 0), ("z", 1001, "job", ["en"], T0 + 20_000_000, 0)]
    want = [r for r in plain_clock(rows, rules)]
    batches = [stamped(rows[k : k + 15], 4) for k in range(0, len(rows), 15)] + [stamped([r], 4) for r in last]
    stream = lanes.worked_off_stream(fed(spark, tmp_path, "jobs", batches, JOB), rules, "0 seconds")
    got = [tuple(r) for r in drained(stream, tmp_path, "jobs") if r.session_id != "z"]
    assert sorted(got, key=repr) == want
