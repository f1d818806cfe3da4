"""Shared fetches against a plain walk over each path's requests."""

import random
from datetime import datetime, timedelta, timezone

from folioworks.operators.requests import fetches

REQUESTS = "path string, event_id long, ts timestamp, done_ts timestamp, found boolean"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def walked(requests, evictions):
    """One fetch is remembered a path: until when it serves."""
    out, serving = {}, {}
    for path, event_id, ts, done, found in sorted((r for r in requests if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        key = path.lower()
        by, until = serving.get(key, (None, -1))
        if by is None or (until is not None and ts >= until):
            if done is None:
                until = None
            else:
                until = max(ts, done)
                if found:
                    until = min((t for p, t in evictions if p is not None and t is not None and p.lower() == key and t >= until), default=None)
            serving[key] = by, until = event_id, until
        out[event_id] = (by == event_id, by)
    return out


def run(spark, requests, evictions, span):
    asked = spark.createDataFrame([(p, i, at(t), at(d), f) for p, i, t, d, f in requests], REQUESTS)
    gone = spark.createDataFrame([(p, at(t)) for p, t in evictions], "path string, ts timestamp")
    rows = fetches(asked, gone, span).collect()
    assert len(rows) == len({r.event_id for r in rows})
    return {r.event_id: (r.fetched, r.served_by) for r in rows}


def test_fetches_against_a_walk(spark):
    rng = random.Random(5)
    requests, evictions = [], []
    for i in range(1500):
        path = rng.choice(["/hot.gif"] * 4 + ["/HOT.gif", "/a.png", "/b.css"])
        ts = rng.randrange(4000)
        done = rng.choice([ts, ts + 1, ts + rng.randrange(40), ts + rng.randrange(40), ts - 5])
        requests.append((path, i * 7 % 1501, ts, done, rng.choice([True, False, False, None])))
    for _ in range(300):
        evictions.append((rng.choice(["/hot.gif", "/hot.GIF", "/a.png"]), rng.randrange(4000)))
    want = walked(requests, evictions)
    assert 100 < sum(f for f, _ in want.values()) < 1400
    for span in (10, 500, 100_000):
        assert run(spark, requests, evictions, span) == want


def test_a_long_chain_of_fetches(spark):
    """Each fetch begins while a later request's end is open, so all are one island."""
    requests = [("/x", i, 2 * i, 2 * i + 3, False) for i in range(700)]
    assert run(spark, requests, [], 60) == walked(requests, [])


def test_odd_requests(spark):
    requests = [
        ("/a", 1, 10, None, True), ("/a", 2, 500, 501, True), (None, 3, 10, 11, True), ("/b", 4, None, 11, True),
        ("/c", 5, 20, 20, False), ("/c", 6, 20, 20, False), ("/d", 7, 5, 9, True), ("/d", 8, 9, 9, True), ("/d", 9, 12, 13, True), ("", 10, -7, 1, None),
    ]
    evictions = [("/d", 8), ("/d", 12), (None, 3), ("/a", None)]
    got = run(spark, requests, evictions, 10)
    assert got == walked(requests, evictions)
    assert got[2] == (False, 1) and got[6] == (True, 6) and got[8] == (False, 7) and got[9] == (True, 9)


def test_no_requests(spark):
    assert run(spark, [], [("/a", 1)], 10) == {}
    assert run(spark, [("/a", 1, 0, 1, True)], [], 10) == {1: (True, 1)}
