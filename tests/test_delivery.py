"""Breakers under changing settings, retries told from attempts, and scans without a key."""

import datetime as dt
import json
import random

import pytest

from seqloom.functions import vocabulary as v
from seqloom.operators import delivery, skew
from seqloom.operators.delivery import Breaker, Passage, after

T0 = dt.datetime(2024, 1, 1)
ATTEMPT = "endpoint string, attempt_id bigint, ts timestamp_ntz, status_code int, transport_error boolean"
CHANGE = "key string, value string, version bigint, ts timestamp_ntz"


def played(state, rows):
    b = Breaker(*state)
    for now, failed, failures, probes, open_micros, fresh in rows:
        if fresh:
            b = Breaker()
        b.call(now, bool(failed), failures, probes, open_micros)
    return b.mode, b.count, b.until if b.mode == delivery.OPEN else 0


@pytest.mark.parametrize("seed", range(4))
def test_passage_of_every_state(seed):
    """The summary of a range does to every state what its attempts do."""
    rng = random.Random(seed)
    for _ in range(700):
        now, rows = 100, []
        open_micros, probes, fails, anew = rng.choice([0, 3, 10, 40]), rng.randint(1, 4), rng.random(), rng.choice([0, 0, 0.1])
        for i in range(rng.randint(1, 14)):
            now += rng.choice([0, 1, 5, 20])
            fresh = i > 0 and rng.random() < anew
            if fresh:
                open_micros, probes = rng.choice([0, 3, 10, 40]), rng.randint(1, 4)
            rows.append((now, int(rng.random() < fails), rng.randint(1, 5), probes, open_micros, int(fresh)))
        summary = json.loads(json.dumps(Passage(rows).summary()))
        states = [(delivery.CLOSED, c, 0) for c in range(8)] + [(delivery.HALF_OPEN, c, 0) for c in range(rows[0][3])]
        for state in states + [(delivery.OPEN, 0, u) for u in range(95, now + 25, 3)]:
            mode, count, until = after(state, summary)
            assert (mode, count, until if mode == delivery.OPEN else 0) == played(state, rows)


def test_long_ranges_need_no_recursion():
    rows = [(i, i % 3 > 0, 2, 1, 5, i % 2) for i in range(50_000)]
    mode, count, until = after((delivery.CLOSED, 0, 0), Passage(rows).summary())
    assert (mode, count, until if mode == delivery.OPEN else 0) == played((delivery.CLOSED, 0, 0), rows)


def random_attempts(spark, seed, n=260):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), i, T0 + dt.timedelta(seconds=13 * (i // 2)), rng.choice([500, 503, 200, 404, None]), None) for i in range(n)]
    rows = [(*r[:4], r[3] is None) for r in rows]
    keys = [*v.BREAKER_DEFAULTS, "failure_threshold", "other"]
    changes = [(rng.choice(keys), rng.choice(["1", "2", "3", "40", "x", "0", None]), k, T0 + dt.timedelta(seconds=13 * rng.randrange(n // 2))) for k in range(40)]
    return rows, changes, spark.createDataFrame(rows, ATTEMPT), spark.createDataFrame(changes, CHANGE)


def sequential(rows, changes):
    """Attempt by attempt: the settings before it, and a breaker per endpoint that is made anew when two of them change."""
    settings, breakers, out = dict(v.BREAKER_DEFAULTS), {}, []
    events = [(ts, 0, n, key, value) for key, value, n, ts in changes] + [(r[2], 1, r[1], r) for r in rows]
    for event in sorted(events, key=lambda e: e[:3]):
        if event[1] == 0:
            key, value = event[3:]
            if key in settings and value and value.isdigit() and int(value) > 0:
                settings[key] = int(value)
            continue
        endpoint, number, ts, code, lost = event[3]
        shape = settings["success_threshold"], settings["open_duration_seconds"]
        if endpoint not in breakers or breakers[endpoint][1] != shape:
            breakers[endpoint] = (Breaker(), shape)
        b = breakers[endpoint][0]
        now = int((ts - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
        called = b.call(now, bool(lost) or code >= 500, settings["failure_threshold"], shape[0], shape[1] * 10**6)
        out.append((number, called, delivery._NAMES[b.mode]))
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [1_000_000, 40])
def test_breaker_under_settings(spark, hot_rows):
    rows, changes, attempts, change_log = random_attempts(spark, 3)
    spark.conf.set("spark.seqloom.hotRows", str(hot_rows))
    try:
        got = delivery.breaker_replay(attempts, changes=change_log).select("attempt_id", "called", "breaker_state").collect()
    finally:
        spark.conf.unset("spark.seqloom.hotRows")
    assert sorted(map(tuple, got)) == sequential(rows, changes)
    assert {r.breaker_state for r in got} == {"open", "closed", "half-open"} and not all(r.called for r in got)


def test_config_ranges_are_bounded(spark):
    """Thousands of changes within one hour: no range takes many more rows than it may."""
    rows = [("failure_threshold", str(i % 9), i, T0 + dt.timedelta(microseconds=i // 4)) for i in range(6000)]
    log = spark.createDataFrame(rows, CHANGE).repartition(4)
    spark.conf.set("spark.seqloom.hotRows", "1000")
    try:
        sizes = [r["count"] for r in skew.ranged(log, ["ts", "version"]).groupBy("_range").count().collect()]
        got = {r.version: r.failure_threshold for r in delivery.effective_config(log).collect()}
    finally:
        spark.conf.unset("spark.seqloom.hotRows")
    assert max(sizes) <= 1000 and sum(sizes) == 6000
    last, want = v.BREAKER_DEFAULTS["failure_threshold"], {}
    for _, value, version, _ in rows:
        last = int(value) or last
        want[version] = last
    assert got == want


MADE = "outbox_id string, attempt_id bigint, ts timestamp_ntz, status_code int, transport_error boolean, called boolean"


def history(spark, rows):
    made = [(o, i, T0 + dt.timedelta(seconds=s), c, c is None, called) for i, (o, s, c, called) in enumerate(rows)]
    found = delivery.retry_history(spark.createDataFrame(made, MADE)).collect()
    return sorted((r.outbox_id, r.attempt_id, r.result, r.dispatch, r.attempt, r.wait_after, r.waited, r.early) for r in found)


def test_retries(spark):
    rows = [
        ("one", 0, 200, True),
        ("two", 0, 503, True), ("two", 5, 204, True),
        ("three", 0, 404, True), ("three", 4, None, True), ("three", 14, 500, True), ("three", 60, 500, True), ("three", 65, 200, True),
        ("shut", 0, 500, True), ("shut", 5, 500, False), ("shut", 6, 200, False), ("shut", 40, 500, True),
    ]
    got = history(spark, rows)
    assert got == sorted([
        ("one", 0, "delivered", 1, 1, 0, 0, False),
        ("two", 1, "failed", 1, 1, 5, 5, False), ("two", 2, "delivered", 1, 2, 0, 5, False),
        ("three", 3, "refused", 1, 1, 5, 5, True), ("three", 4, "failed", 1, 2, 10, 15, False), ("three", 5, "failed", 1, 3, 15, 30, False),
        ("three", 6, "failed", 2, 1, 5, 5, False), ("three", 7, "delivered", 2, 2, 0, 5, False),
        ("shut", 8, "failed", 1, 1, 5, 5, False), ("shut", 9, "rejected", 1, 2, 0, 5, False),
        ("shut", 10, "rejected", 2, 1, 0, 0, False), ("shut", 11, "failed", 3, 1, 5, 5, False),
    ])


def test_hot_rows_retry_alike(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b"]), i, rng.choice([200, 500, 404, None]), rng.random() < 0.8) for i in range(120)]
    want = history(spark, rows)
    spark.conf.set("spark.seqloom.hotRows", "8")
    try:
        assert history(spark, rows) == want
    finally:
        spark.conf.unset("spark.seqloom.hotRows")


def test_attempts_find_their_row(spark):
    outbox = spark.createDataFrame([("x", "o1", T0), ("y", "o1", T0 + dt.timedelta(seconds=10)), ("z", "o2", T0)], "id string, aggregate_id string, created_at timestamp_ntz")
    rows = [(0, "o1", -1), (1, "o1", 0), (2, "o1", 9), (3, "o1", 10), (4, "o1", 99), (5, "o2", 5), (6, "o3", 5)]
    attempts = spark.createDataFrame([(i, o, T0 + dt.timedelta(seconds=s)) for i, o, s in rows], "attempt_id bigint, order_id string, ts timestamp_ntz")
    want = {1: "x", 2: "x", 3: "y", 4: "y", 5: "z"}
    for hot_rows in ("1000000", "2"):
        spark.conf.set("spark.seqloom.hotRows", hot_rows)
        try:
            assert {r.attempt_id: r.outbox_id for r in delivery.matched_attempts(outbox, attempts).collect()} == want
        finally:
            spark.conf.unset("spark.seqloom.hotRows")


def test_an_endpoint_is_replayed_as_a_stream(spark):
    """An endpoint's breaker passes from one Arrow batch to the next; nothing is grouped whole."""
    rows, _, attempts, _ = random_attempts(spark, 11)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        replayed = delivery.breaker_replay(attempts, open_seconds=60)
        assert "FlatMapGroupsInPandas" not in replayed._jdf.queryExecution().toString()
        got = {r.attempt_id: (r.called, r.breaker_state) for r in replayed.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, breakers = {}, {}
    for endpoint, number, ts, code, lost in sorted(rows, key=lambda r: (r[2], r[1])):
        b = breakers.setdefault(endpoint, Breaker())
        failed = lost or code >= 500
        called = b.call(int((ts - T0).total_seconds() * 1e6), failed, v.BREAKER_DEFAULTS["failure_threshold"], v.BREAKER_DEFAULTS["success_threshold"], 60_000_000)
        want[number] = (called, delivery._NAMES[b.mode])
    assert got == want
