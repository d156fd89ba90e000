import datetime as dt

import pytest
from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators.replay import Lifetimes
from seqloom.streaming import gate, sinks
from tests import literal
from tests.literal import event, log_of, steps, uid


def stream_of(spark, tmp_path, batches, lifetimes=gate.STANDARD):
    """Run batches of rows as files, one file per micro-batch."""
    folder = str(tmp_path / "in")
    for rows in batches:
        log_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    log = spark.readStream.schema(literal.LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    return sinks.run_gate(log, lifetimes).cache()


def test_same_as_row_by_row_model(spark, tmp_path):
    rows = literal.random_log(seed=5, plans=40, faults=0.2)
    half = len(rows) // 2
    written = stream_of(spark, tmp_path, [rows[:half], rows[half:]], Lifetimes())
    expected = literal.run(rows)
    got = {r.pos: r.verdict for r in written.filter("kind = 'verdict'").collect()}
    assert got == expected["verdicts"]
    applied = written.filter("kind = 'applied'").collect()
    assert (
        sorted((r.plan_id, r.seq_id, r.pos, r.applied_pos) for r in applied) == expected["applied"]
    )
    state, outbox = sinks.order_tables(written)
    store = {r.id: (r.user_id, r.status, r.total_amount, r.plan_id, r.last_seq_processed) for r in state.collect()}
    assert store == {k: s[:5] for k, s in expected["store"].items()}
    assert outbox.count() == len(expected["outbox"])


@pytest.mark.parametrize("batches", [1, 3])
def test_idle_buffers_time_out_and_aborts_lapse(spark, tmp_path, batches):
    hour, day = 3600, 86400
    rows = (
        steps(1, 3, plan="plan_idle", order=uid(1))
        + steps(1, 3, plan="plan_late", order=uid(2))
        + steps(1, "A", plan="plan_lapse", order=uid(3))
    )
    at = lambda s: literal.T0 + dt.timedelta(seconds=s)
    rows.append(event(50, "plan_late", uid(2), 4, ts=at(hour // 2)))
    rows.append(event(60, "plan_late", uid(2), 2, ts=at(hour)))  # in time: refreshed by step 4
    rows.append(event(70, "plan_lapse", uid(3), 2, ts=at(2 * hour)))  # still aborted
    rows.append(event(80, "plan_lapse", uid(3), 2, ts=at(day + hour)))  # lapsed
    rows.append(event(90, "plan_close", uid(4), 1, ts=at(3 * day)))  # moves the watermark
    rows.sort(key=lambda r: r[6])
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    written = stream_of(spark, tmp_path, parts)
    letters = sinks.timeout_letters(written).collect()
    assert [(r.plan_id, r.seq_id, r.error_code) for r in letters] == [
        ("plan_idle", 3, v.BUFFER_TIMEOUT)
    ]
    applied = written.filter("kind = 'applied'").collect()
    done = {}
    for r in applied:
        done.setdefault(r.plan_id, set()).add(r.seq_id)
    assert done["plan_late"] == {1, 2, 3, 4}
    assert done["plan_lapse"] == {1, 2}
    state, _ = sinks.order_tables(written)
    assert {r.plan_id: r.status for r in state.collect()}["plan_lapse"] == "inventory_validated"
    assert written.filter((F.col("kind") == "verdict") & (F.col("pos") == 70)).first().verdict == v.ABORTED


def test_twins_wait_behind_the_smallest(spark, tmp_path):
    rows = steps(1, (3, "b"), (3, "a"), (3, "b"), (3, "c"), 2)
    rows.append(event(99, "plan_close", uid(4), 1, ts=literal.T0 + dt.timedelta(days=1)))
    written = stream_of(spark, tmp_path, [rows])
    taken = written.filter("kind = 'applied' and plan_id = 'plan_a'").collect()
    assert sorted((r.seq_id, r.payload) for r in taken if r.seq_id == 3) == [(3, "a")]
    assert sorted(r.payload for r in sinks.timeout_letters(written).collect()) == ["b", "c"]


def test_no_event_is_too_late(spark, tmp_path):
    """Rows hours behind the watermark are judged, applied and dead-lettered like any other."""
    at = lambda s: literal.T0 + dt.timedelta(seconds=s)
    hour = 3600
    batches = [
        [event(1, "plan_a", uid(1), 1, ts=at(0)), event(2, "plan_a", uid(1), 3, ts=at(10))],
        [event(3, "plan_b", uid(2), 1, ts=at(6 * hour))],
        [event(4, "plan_b", uid(2), 2, ts=at(12 * hour))],
        [event(5, "plan_a", uid(1), 2, ts=at(20)), event(6, "plan_c", uid(3), 2, ts=at(30))],
        [event(7, "plan_b", uid(2), 3, ts=at(13 * hour))],
    ]
    written = stream_of(spark, tmp_path, batches)
    verdicts = {r.pos: r.verdict for r in written.filter("kind = 'verdict'").collect()}
    assert verdicts == {1: "OK", 2: "OUT_OF_ORDER", 3: "OK", 4: "OK", 5: "OK", 6: "OUT_OF_ORDER", 7: "OK"}
    letters = {r.pos for r in sinks.timeout_letters(written).collect()}
    applied = {r.pos for r in written.filter("kind = 'applied'").collect()}
    assert letters == {2, 6} and applied == {1, 3, 4, 5, 7}
