import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v
from seqloom.operators import contracts, delivery, faults, orders, pipeline, planner, reports, sequence
from seqloom.sources import tables, wire
from seqloom.sources.tables import ITEM
from tests.literal import T0, event, log_of, steps, uid

# --- planner ---
GOOD = [("p1", 2, 50.0)]
REQUEST = f"request_key int, order_id string, user_id string, items array<{ITEM}>, total_amount double, currency string, created timestamp_ntz"


def plans(spark, *requests):
    rows = [(i, None, "u", items, total, None, T0) for i, (items, total) in enumerate(requests)]
    df = spark.createDataFrame(rows, REQUEST)
    return planner.plan_validate(planner.totals_from_array(planner.order_defaults(df)))


def test_planner_rules(spark):
    cases = [(GOOD, 100.0), ([], 100.0), (None, 1.0), (GOOD, 0.0), (GOOD, 200000.0), (GOOD, 999.0)]
    got = [r.abort_reason for r in plans(spark, *cases).orderBy("request_key").collect()]
    expected = [None, "items_empty", "items_empty", "invalid_amount", "amount_exceeds_limit"]
    assert got == [*expected, "amount_mismatch"]


def test_planner_events_and_tombstones(spark):
    events = planner.plan_route(plans(spark, (GOOD, 100.0), (GOOD, 999.0)))
    rows = events.withColumn("value", planner.envelope_json(events)).collect()
    five = [r for r in rows if r.seq_id is not None]
    assert [(r.seq_id, r.event_type) for r in sorted(five, key=lambda r: r.seq_id)] == list(
        enumerate(v.SEQUENCED_TYPES, 1)
    )
    assert len({r.event_id for r in rows}) == 6
    (tomb,) = [json.loads(r.value) for r in rows if r.seq_id is None]
    assert "seq_id" not in tomb and tomb["event_type"] == v.ABORT
    assert tomb["data"] == {
        "reason": v.ABORT_REASON_PREFIX + "amount_mismatch",
        "abort_code": "manual",
        "aborted_at_seq": 0,
    }
    created = json.loads(next(r.value for r in five if r.seq_id == 1))
    assert created["data"]["items"] == [{"product_id": "p1", "quantity": 2, "unit_price": 50.0}]


def test_abort_codes(spark):
    reasons = spark.createDataFrame([("payment_rejected",), ("inventory_failed",), ("odd",)], "r string")
    got = [r[0] for r in reasons.select(s.abort_code_of(F.col("r"))).collect()]
    assert got == ["payment_rejected", "inventory_failed", "manual"]


# --- parsing and contracts ---
def raw(spark, *values):
    rows = [("k", value, None, 0, i, T0) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, wire.RAW_SCHEMA)


@pytest.mark.parametrize(
    "text, ok",
    [
        ('{"event_id":"a","seq_id":1,"data":{}}', True),
        ('{"event_id":"a","seq_id":null}', True),
        ("{}", True),
        ("null", True),
        ("not json", False),
        ("", False),
        ("[1]", False),
        ('{"event_id":"a"}x', False),
        ('{"event_id":"a"} {"event_id":"b"}', False),
        ('{"seq_id":"1"}', False),
        ('{"seq_id":1.5}', False),
        ('{"seq_id":99999999999}', True),
        ('{"seq_id":99999999999999999999}', False),
        ('{"event_id":7,"event_id":"a","data":{"x":1,"x":2}}', True),
        ('{"event_id":7}', False),
        ('{"data":"text"}', False),
    ],
)
def test_strict_parsing(spark, text, ok):
    assert wire.parse_envelope(raw(spark, text)).first().parse_ok is ok


def test_payload_fields_keep_their_types(spark):
    texts = [
        '{"seq_id":1,"data":{"user_id":"u","total_amount":3}}',
        '{"seq_id":1,"data":{"user_id":7,"total_amount":"3"}}',
    ]
    rows = wire.typed_rows(wire.parse_envelope(raw(spark, *texts))).orderBy("pos").collect()
    assert [(r.user_id, r.total_amount) for r in rows] == [("u", 3.0), (None, None)]


def test_last_header_wins(spark):
    df = spark.createDataFrame(
        [([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("a", bytearray(b"3"))],)],
        "h array<struct<key:string,value:binary>>",
    )
    assert df.select(wire.header_map(F.col("h")).alias("m")).first().m == {"a": "3", "b": "2"}


def failed(spark, kind, data, contract):
    df = spark.createDataFrame([(kind, data)], "t string, d string")
    rules = contracts.validate_payload(F.col("t"), F.parse_json("d"), contract)
    return df.select(rules.alias("f")).first().f


def test_contracts(spark):
    shipped = '{"tracking_code":"t","carrier":"c","estimated_delivery":"2024-01-06T00:00:00Z"}'
    assert failed(spark, "OrderShipped", shipped, "declared") == ["estimated_delivery:format"]
    assert failed(spark, "OrderShipped", shipped, "producer") == []
    created = '{"user_id":"u","items":[{"product_id":"p","quantity":0,"unit_price":1}],"total_amount":-1,"x":1}'
    assert failed(spark, "OrderCreated", created, "declared") == [
        "items:items",
        "total_amount:minimum",
        "currency:required",
        "additionalProperties",
    ]
    assert failed(spark, "OrderCreated", created, "producer") == ["items:items", "total_amount:minimum"]
    assert failed(spark, "Nothing", "{}", "declared") is None


def test_dead_letters(spark):
    good = '{"event_id":"e%d","event_type":"%s","plan_id":"plan_a","seq_id":%d,"order_id":"%s","data":{}}'
    texts = ["oops", '{"event_id":"x","event_type":"OrderCreated","plan_id":"plan_b"}']
    texts += [good % (1, "OrderCreated", 1, uid(1)), good % (2, "Mystery", 2, uid(1))]
    typed = wire.typed_rows(wire.parse_envelope(raw(spark, *texts)))
    gated = pipeline.process_log(wire.log_of(typed)).gated
    letters = wire.dead_letters(typed, gated)
    got = {(r.pos // wire.MAX_PARTITIONS, r.error_code, r.key) for r in letters.collect()}
    assert got == {(0, v.PARSE_ERROR, None), (1, v.MISSING_SEQ_ID, ""), (3, v.DB_ERROR, uid(1))}
    records = wire.dead_letter_records(letters).collect()
    assert sorted(len(r.headers) for r in records) == [2, 3, 3]
    assert "oops" in {r.value for r in records}


# --- stores, faults and reports ---
def planned(spark, n=4):
    rows = []
    for i in range(n):
        rows += steps(1, 2, 3, 4, 5, plan=f"plan_{i}", order=uid(i))
    return log_of(spark, rows)


def test_end_to_end_report(spark):
    log = planned(spark)
    done = pipeline.process_log(log)
    row = reports.e2e_report(log, done.orders, done.outbox).first()
    assert (row.plans_sent, row.events_sent, row.plans_completed, row.outbox_duplicates) == (4, 20, 4, 0)
    assert row.result == "exactly_once"


def test_fault_scenarios(spark):
    log = planned(spark)
    late = pipeline.process_log(faults.late_step(log))
    assert reports.gap_scenario_check(late.orders).first().passed
    zombies = pipeline.process_log(faults.abort_after(log))
    assert reports.zombie_check(zombies.orders).first().passed
    once, twice = pipeline.process_log(log), pipeline.process_log(faults.resend_all(log))
    assert reports.state_changes(once.orders, twice.orders).count() == 0
    assert reports.outbox_duplicates(twice.outbox).count() == 0
    mixed = pipeline.process_log(faults.shuffled(log, seed=4))
    columns = ["id", "status", "last_seq_processed", "plan_id"]
    assert mixed.orders.select(*columns).exceptAll(once.orders.select(*columns)).count() == 0


def test_second_plan_of_an_order_must_pass_the_first(spark):
    rows = steps(1, 2, 3, plan="plan_a", start=1) + steps(1, 2, 3, 4, plan="plan_b", start=10)
    done = pipeline.process_log(log_of(spark, rows))
    skipped = sorted(r.seq_id for r in orders.db_skips(done.guarded).collect())
    assert skipped == [1, 2, 3]
    assert done.orders.first().plan_id == "plan_b" and done.outbox.count() == 4


def test_tombstones_of_unknown_and_completed_orders(spark):
    rows = steps("A", plan="plan_x", order=uid(9)) + steps(1, 2, 3, 4, 5, "A", "A", start=10)
    done = pipeline.process_log(log_of(spark, rows))
    (row,) = done.orders.collect()
    assert (row.status, row.last_seq_processed) == ("aborted", 5)
    assert row.updated_at == T0 + dt.timedelta(seconds=15)
    assert done.outbox.filter("event_type = 'ABORT_PLAN'").count() == 3


def test_first_user_and_last_amount_stay(spark):
    rows = [
        event(1, "plan_a", uid(1), 1, amount=10.0),
        event(2, "plan_a", uid(1), 2, user="late"),
        event(3, "plan_a", uid(1), 3, amount=123456789.0),
    ]
    row = pipeline.process_log(log_of(spark, rows)).orders.first()
    assert (row.user_id, str(row.total_amount), row.last_seq_processed) == ("unknown", "10.00", 2)


def test_replicas_diverge(spark):
    states = spark.createDataFrame(
        [("alpha", "o1", 2), ("beta", "o1", 2), ("alpha", "o2", 1), ("beta", "o3", 4)],
        "replica string, order_id string, last_seq int",
    )
    got = sorted((r.order_id, r.alpha_seq, r.beta_seq) for r in reports.replica_divergence(states).collect())
    assert got == [("o2", 1, None), ("o3", None, 4)]


# --- delivery ---
ATTEMPT = "endpoint string, attempt_id bigint, ts timestamp_ntz, status_code int, transport_error boolean"


def attempts(spark, *codes, endpoint="h", gap=1):
    rows = [(endpoint, i, T0 + dt.timedelta(seconds=i * gap), c, c is None) for i, c in enumerate(codes)]
    return spark.createDataFrame(rows, ATTEMPT)


def test_breaker_trips_after_five(spark):
    rows = delivery.breaker_replay(attempts(spark, *[500] * 6)).orderBy("attempt_id").collect()
    assert [r.called for r in rows] == [True] * 5 + [False]
    assert rows[4].breaker_state == "open"


def test_breaker_recovers_through_probes(spark):
    codes = [500] * 5 + [200] * 3 + [404]
    rows = delivery.breaker_replay(attempts(spark, *codes, gap=31)).orderBy("attempt_id").collect()
    assert [r.breaker_state for r in rows[4:]] == ["open", "half-open", "closed", "closed", "closed"]


def test_hot_endpoint_replays_like_an_ordinary_one(spark):
    import random

    rng = random.Random(1)
    codes = [rng.choice([500, 500, 500, 200, None]) for _ in range(300)]
    df = attempts(spark, *codes, gap=97)
    expected = sorted(delivery.breaker_replay(df, open_seconds=3000).collect())
    streaks = sorted(delivery.failure_streaks(df, 5).collect())
    spark.conf.set("spark.seqloom.hotRows", "50")
    try:
        assert sorted(delivery.breaker_replay(df, open_seconds=3000).collect()) == expected
        assert sorted(delivery.failure_streaks(df, 5).collect()) == streaks
    finally:
        spark.conf.unset("spark.seqloom.hotRows")


def test_config_defaults_and_bad_values(spark):
    rows = [
        ("failure_threshold", "x", 1, T0),
        ("failure_threshold", "0", 2, T0),
        ("failure_threshold", "7", 3, T0 + dt.timedelta(hours=2)),
        ("open_duration_seconds", "-4", 4, T0 + dt.timedelta(hours=5)),
    ]
    df = spark.createDataFrame(rows, "key string, value string, version bigint, ts timestamp_ntz")
    got = [tuple(r)[2:] for r in delivery.effective_config(df).orderBy("version").collect()]
    assert got == [(5, 2, 10, 30), (5, 2, 10, 30), (7, 2, 10, 30), (7, 2, 10, 30)]


def test_outbox_batch_and_receipts(spark):
    outbox = pipeline.process_log(planned(spark)).outbox
    first = delivery.outbox_next_batch(outbox, 3)
    marked = delivery.outbox_mark(outbox, first)
    assert marked.filter("processed").count() == 3
    waits = [
        (r.attempt, r.wait_after, r.waited_total)
        for r in delivery.retry_schedule(first.limit(1)).orderBy("attempt").collect()
    ]
    assert waits == [(1, 5, 5), (2, 10, 15), (3, 15, 30)]


def test_a_tombstone_with_a_large_amount_still_aborts(spark):
    rows = steps(1, plan="plan_t", order=uid(7))
    rows.append(event(9, "plan_t", uid(7), None, v.ABORT, amount=1e12))
    done = pipeline.process_log(log_of(spark, rows))
    assert [r.status for r in done.orders.collect()] == ["aborted"]
    assert done.outbox.count() == 2


def test_columns_have_limits(spark):
    rows = [
        event(1, "plan_l", uid(1), 1, user="u" * 51),
        event(2, "p" * 101, uid(2), 1),
        event(3, "plan_s", uid(3), 1, user="u" * 50),
    ]
    errors = {r.pos: r.persist_error for r in orders.with_persist_error(log_of(spark, rows)).collect()}
    assert errors == {1: "user id too long", 2: "plan id too long", 3: None}


def test_equal_offsets_of_two_partitions(spark):
    text = '{"event_id":"%s","event_type":"OrderCreated","plan_id":"plan_p","seq_id":1,"order_id":"' + uid(1) + '"}'
    rows = [(None, text % e, [], p, 5, T0) for p, e in enumerate("ab")]
    typed = wire.typed_rows(wire.parse_envelope(spark.createDataFrame(rows, wire.RAW_SCHEMA)))
    gated = sequence.seq_gate(wire.log_of(typed)).collect()
    assert sorted(r.verdict for r in gated) == ["DUPLICATE", "OK"] and sum(r.applied for r in gated) == 1


def test_large_steps_wait(spark):
    big = 3_000_000_000
    text = '{"event_id":"e","event_type":"OrderCreated","plan_id":"plan_p","seq_id":%d,"order_id":"x"}' % big
    typed = wire.typed_rows(wire.parse_envelope(spark.createDataFrame([(None, text, [], 0, 1, T0)], wire.RAW_SCHEMA)))
    row = sequence.seq_gate(wire.log_of(typed)).first()
    assert (row.seq_id, row.verdict) == (big, v.OUT_OF_ORDER)


def test_requests_no_event_can_be_made_of(spark):
    texts = [
        "{broken", '{"total_amount":5.0}', '{"items":[{"quantity":1,"unit_price":5.0}]}',
        '{"items":[{"quantity":null,"unit_price":5.0}],"total_amount":5.0}',
        '{"items":[{"quantity":-1,"unit_price":-5.0}],"total_amount":5.0}',
        '{"items":[{"quantity":1,"unit_price":5.0}],"total_amount":5.0}', None,
    ]
    rows = spark.createDataFrame([(i, T0, t) for i, t in enumerate(texts)], "request_key long, created timestamp_ntz, value string")
    judged = planner.plan_validate(planner.totals_from_array(planner.order_defaults(tables.orders_json(rows))))
    got = {r.request_key: (r.request_error, r.abort_reason, r.status) for r in judged.collect()}
    assert got == {
        0: ("unreadable", None, "failed"), 1: (None, "items_empty", "aborted"), 2: ("no_total", None, "failed"),
        3: ("item_incomplete", None, "failed"), 4: ("item_invalid", None, "failed"), 5: (None, None, "planning"),
        6: ("unreadable", None, "failed"),
    }
    assert {r.order_id for r in planner.plan_route(judged).collect()} == {r.order_id for r in judged.filter("request_error is null").collect()}
