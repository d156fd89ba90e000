"""The gate under the clock against the row-by-row model, and texts that are more than one message."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators import lifetimes
from seqloom.operators.replay import Lifetimes
from seqloom.sources import wire
from tests import literal
from tests.literal import event, log_of, steps, uid

HOUR, DAY = 3600, 86400


def at(seconds):
    return literal.T0 + dt.timedelta(seconds=seconds)


def slow_log(seed, plans=40):
    """A random log whose clock runs at an uneven pace, with late time stamps."""
    rng = random.Random(seed)
    rows, now = [], 0
    for row in literal.random_log(seed, plans, aborts=0.08):
        now += rng.choice([1, 30, 600, 2400])
        late = rng.choice([0, 0, 0, 0, 5000])
        rows.append((*row[:5], at(now - late), *row[6:]))
    return rows


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
@pytest.mark.parametrize("lives", [lifetimes.STANDARD, Lifetimes(abort=2 * HOUR * 10**6, buffer=None), Lifetimes(abort=None, buffer=900 * 10**6), Lifetimes()])
def test_like_the_model(spark, hot_rows, lives):
    rows = slow_log(31)
    spark.conf.set("spark.seqloom.hotRows", str(hot_rows))
    try:
        log = log_of(spark, rows)
        end = lifetimes.end_of(log, dt.timedelta(minutes=10))
        facts = lifetimes.gate_by_the_clock(log, lives, end).collect()
    finally:
        spark.conf.unset("spark.seqloom.hotRows")
    want = literal.run(rows, lives, max(r[5] for r in rows) - dt.timedelta(minutes=10))
    assert {r.pos: r.verdict for r in facts if r.kind == "verdict"} == want["verdicts"]
    assert sorted((r.plan_id, r.seq_id, r.pos, r.applied_pos) for r in facts if r.kind == "applied") == want["applied"]
    gone = sorted(r.pos for r in facts if r.kind == "timeout")
    assert gone == [p for p, code in want["dead"] if code == v.BUFFER_TIMEOUT]
    assert sorted(r.pos for r in facts if r.kind == "abort") == sorted(r[6] for r in rows if r[4] == v.ABORT)


def test_plain_plans_are_not_replayed(spark):
    rows = steps(1, 3, 2, plan="plan_a") + steps(1, 3, plan="plan_b", start=10) + steps(1, "A", 2, plan="plan_c", start=20)
    rows.append(event(40, "plan_d", uid(4), 1, ts=at(0)))
    rows.append(event(41, "plan_d", uid(4), 3, ts=at(10)))
    rows.append(event(42, "plan_d", uid(4), 2, ts=at(30 + HOUR)))
    log = log_of(spark, rows)
    from seqloom.operators import orders, sequence

    gated = sequence.seq_gate(orders.with_persist_error(log), store_faults=True)
    clocked = lifetimes.clocked_plans(gated, lifetimes.STANDARD, None).collect()
    assert [r.plan_id for r in clocked] == ["plan_d"]
    facts = lifetimes.gate_by_the_clock(log, lifetimes.STANDARD, lifetimes.end_of(log, dt.timedelta(0)))
    letters = lifetimes.timeout_letters(facts).collect()
    assert sorted((r.plan_id, r.seq_id) for r in letters) == [("plan_b", 3), ("plan_d", 3)]


def test_abort_lapses(spark):
    rows = steps(1, "A", plan="plan_a")
    rows += [event(9, "plan_a", uid(1), 2, ts=at(2 * HOUR)), event(10, "plan_a", uid(1), 2, ts=at(DAY + 60)), event(11, "plan_a", uid(1), 3, ts=at(DAY + 61))]
    facts = lifetimes.gate_by_the_clock(log_of(spark, rows))
    assert sorted((r.seq_id, r.pos) for r in lifetimes.resumed(facts).collect()) == [(2, 10), (3, 11)]
    assert facts.filter("pos = 9").first().verdict == v.ABORTED


def test_empty_log(spark):
    log = log_of(spark, [])
    assert lifetimes.end_of(log, dt.timedelta(0)) is None
    assert lifetimes.gate_by_the_clock(log).count() == 0


GOOD = '{"event_id":"x"}'
BROKEN = [f"{GOOD}] garbage", f"{GOOD}]", f'{GOOD}] ,[{{"a":1}}', f'{GOOD}],"', f"{GOOD} garbage", f'{GOOD},"x"', f"{GOOD}{GOOD}", f"{GOOD},", f",{GOOD}", "", " ", '"', "[", "1,2"]


def test_one_message_and_nothing_else(spark):
    fields = "key string, value string, headers array<struct<key:string,value:binary>>, partition int, offset bigint, timestamp timestamp_ntz"
    texts = [GOOD, f"  {GOOD}\n", "null", *BROKEN, None]
    raw = spark.createDataFrame([(None, t, None, 0, i, None) for i, t in enumerate(texts)], fields)
    got = {r.offset: r.parse_ok for r in wire.parse_envelope(raw).collect()}
    assert [got[i] for i in range(len(texts))] == [True] * 3 + [False] * (len(texts) - 3)
    whole = raw.select("offset", wire.whole_json(F.col("value")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in sorted(whole)] == [True] * 3 + [False] * (len(texts) - 3)


def test_partitions_beyond_the_limit_are_refused(spark):
    rows = spark.createDataFrame([(wire.MAX_PARTITIONS - 1, 7), (3, 7)], "partition int, offset bigint")
    assert rows.select(wire.position().alias("p")).distinct().count() == 2
    with pytest.raises(Exception, match="beyond the limit"):
        spark.createDataFrame([(wire.MAX_PARTITIONS, 7)], "partition int, offset bigint").select(wire.position()).collect()
