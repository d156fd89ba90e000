"""The order table that a stream keeps: against the batch fold, after restarts and replays."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators import pipeline
from seqloom.operators.replay import Lifetimes
from seqloom.sources import messages, wire
from seqloom.streaming import gate, ledger, sinks
from tests import literal
from tests.literal import event, log_of, steps, uid

STATE = ["id", "user_id", "status", "total_amount", "plan_id", "last_seq_processed", "created_at", "updated_at"]


def stream_of(spark, folder, batches):
    """One file, and so one micro-batch, each."""
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(folder)
    schema = batches[0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def sliced(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def as_set(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_five_batches_like_the_batch_fold(spark, tmp_path):
    rows = literal.random_log(seed=17, plans=60, faults=0.2)
    log = stream_of(spark, str(tmp_path / "in"), [log_of(spark, part) for part in sliced(rows, 5)])
    with sinks.rocksdb(spark):
        kept = ledger.run(ledger.order_pipeline(log, Lifetimes()), str(tmp_path / "run"), 1)
    marks = kept.marks()
    assert len([m for m in marks if m.startswith("batch=")]) >= 5
    assert any(m.startswith("base=") for m in marks)
    done = pipeline.process_log(log_of(spark, rows))
    assert as_set(kept.orders(), STATE) == as_set(done.orders, STATE)
    columns = ["id", "aggregate_id", "event_type", "payload", "topic", "processed", "created_at"]
    assert as_set(kept.outbox(), columns) == as_set(done.outbox, columns)
    letters = kept.letters()
    refused = done.gated.filter("applied and persist_error is not null")
    assert as_set(letters, ["pos", "error_reason"]) == as_set(refused, ["pos", F.concat(F.lit(v.REASON_DB_PREFIX), "persist_error")])


def test_restart_and_replay(spark, tmp_path):
    """A batch that dies half written, one that dies after its marker, and one that comes again change nothing."""
    rows = literal.random_log(seed=23, plans=40, faults=0.1)
    log = stream_of(spark, str(tmp_path / "in"), [log_of(spark, part) for part in sliced(rows, 4)])
    path, calls = str(tmp_path / "run"), []
    out = ledger.order_pipeline(log, Lifetimes())
    kept = ledger.Ledger(spark, f"{path}/table", out.schema, 1)

    def dies(batch, n):
        calls.append(n)
        if n == 1 and calls.count(1) == 1:
            batch.limit(3).write.mode("overwrite").partitionBy("kind").parquet(f"{kept.path}/batch=1")
            raise RuntimeError("before the marker")
        kept.commit(batch, n)
        if n == 2 and calls.count(2) == 1:
            raise RuntimeError("after the marker")
        if n == 3:
            before = as_set(kept.orders(), STATE)
            kept.commit(batch, n)
            kept.commit(batch.limit(0), 2)
            assert as_set(kept.orders(), STATE) == before

    with sinks.rocksdb(spark):
        for _ in range(2):
            with pytest.raises(StreamingQueryException, match="the marker"):
                ledger.run(out, path, commit=dies)
            assert kept.orders().count() > 0
        ledger.run(out, path, commit=dies)
    assert calls.count(1) == 2 and calls.count(2) == 2
    done = pipeline.process_log(log_of(spark, rows))
    assert as_set(kept.orders(), STATE) == as_set(done.orders, STATE)
    assert kept.outbox().count() == done.outbox.count()


def test_readers_see_marked_batches_only(spark, tmp_path):
    log = stream_of(spark, str(tmp_path / "in"), [log_of(spark, steps(1, 2))])
    with sinks.rocksdb(spark):
        kept = ledger.run(ledger.order_pipeline(log, Lifetimes()), str(tmp_path / "run"))
    before = as_set(kept.orders(), STATE)
    spark.read.parquet(f"{kept.path}/batch=0").write.partitionBy("kind").parquet(f"{kept.path}/batch=7")
    assert as_set(kept.orders(), STATE) == before and kept.outbox().count() == 2


def test_one_stream_from_record_to_letter(spark, tmp_path):
    """Letters of all codes; those of the batch form plus the timeouts, over a restart."""
    raw = messages.raw_events(spark, "/root/testdata/sf0.001")
    typed = wire.typed_rows(wire.parse_envelope(raw)).cache()
    cuts = typed.approxQuantile("pos", [0.25, 0.5, 0.75], 0)
    low = [typed["pos"] > c for c in [float("-inf"), *cuts]]
    parts = [typed.filter(a & (typed["pos"] <= b)) for a, b in zip(low, [*cuts, float("inf")], strict=True)]
    stream = stream_of(spark, str(tmp_path / "in"), parts)
    path, died = str(tmp_path / "run"), []
    out = ledger.pipeline(stream, Lifetimes(buffer=gate.STANDARD.buffer))
    kept = ledger.Ledger(spark, f"{path}/table", out.schema)

    def dies(batch, n):
        if n == 2 and not died:
            died.append(n)
            batch.limit(5).write.mode("overwrite").partitionBy("kind").parquet(f"{kept.path}/batch=2")
            raise RuntimeError("half way")
        kept.commit(batch, n)

    with sinks.rocksdb(spark):
        with pytest.raises(StreamingQueryException, match="half way"):
            ledger.run(out, path, commit=dies)
        ledger.run(out, path, commit=dies)
    letters = kept.letters().cache()
    codes = {r.error_code for r in letters.select("error_code").distinct().collect()}
    assert codes == {v.PARSE_ERROR, v.MISSING_SEQ_ID, v.DB_ERROR, v.BUFFER_TIMEOUT}
    # Without timeouts the letters are those of the batch form; here only buffers that time out differ.
    want = wire.dead_letters(typed, pipeline.process_log(wire.log_of(typed)).gated)
    fixed = [v.PARSE_ERROR, v.MISSING_SEQ_ID]
    columns = ["pos", "key", "raw", "error_code", "error_reason", "failed_at", "original_event_id"]
    assert as_set(letters.filter(F.col("error_code").isin(fixed)), columns) == as_set(want.filter(F.col("error_code").isin(fixed)), columns)
    assert letters.count() == letters.select("pos").distinct().count()


def test_late_steps_and_lapsed_aborts_in_the_table(spark, tmp_path):
    at = lambda s: literal.T0 + dt.timedelta(seconds=s)
    rows = [
        *steps(1, "A", plan="plan_a", order=uid(1)), event(9, "plan_a", uid(1), 2, ts=at(90_000)),
        *steps(1, 3, plan="plan_b", order=uid(2), start=20), event(30, "plan_c", uid(3), 1, ts=at(300_000)),
    ]
    log = stream_of(spark, str(tmp_path / "in"), [log_of(spark, rows[:3]), log_of(spark, rows[3:5]), log_of(spark, rows[5:])])
    with sinks.rocksdb(spark):
        kept = ledger.run(ledger.order_pipeline(log), str(tmp_path / "run"))
    status = {r.id: (r.status, r.last_seq_processed) for r in kept.orders().collect()}
    assert status == {uid(1): ("inventory_validated", 2), uid(2): ("pending", 1), uid(3): ("pending", 1)}
    assert [(r.pos, r.error_code) for r in kept.letters().collect()] == [(21, v.BUFFER_TIMEOUT)]
