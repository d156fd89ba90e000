"""What a stream holds and counts, read back: against the batch forms."""

from pyspark.sql import functions as F

from seqloom.operators import reports, sequence
from seqloom.operators.replay import Lifetimes
from seqloom.streaming import gate, inspect, rates, sinks
from tests import literal
from tests.literal import log_of


def stream_of(spark, folder, rows, parts):
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        log_of(spark, rows[i : i + size]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(literal.LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_state_like_the_batch_snapshot(spark, tmp_path):
    """As of the last batch and of an earlier one."""
    rows = literal.random_log(seed=41, plans=30, faults=0.0)
    log = stream_of(spark, str(tmp_path / "in"), rows, 3)
    checkpoint = str(tmp_path / "checkpoint")
    with sinks.rocksdb(spark):
        sinks.write_batches(gate.gate_stream(log, Lifetimes()), str(tmp_path / "out"), checkpoint).awaitTermination()
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    size = -(-len(rows) // 3)
    for batch, upto in ((None, len(rows)), (0, size), (1, 2 * size)):
        gated = sequence.seq_gate(log_of(spark, rows[:upto]))
        want = sequence.buffer_snapshot(gated, as_of, 3600).select("plan_id", "members", "min_seq", "max_seq", "last_add", "ttl_left")
        got = inspect.buffer_snapshot(spark, checkpoint, as_of, 3600, batch).select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        counters = inspect.seq_counters(spark, checkpoint, batch)
        assert sorted(map(tuple, counters.collect())) == sorted(map(tuple, sequence.seq_counters(gated).collect()))


def test_rates_are_amended(spark, tmp_path):
    rows = literal.random_log(seed=43, plans=20, faults=0.0)
    log = stream_of(spark, str(tmp_path / "in"), rows, 3)
    with sinks.rocksdb(spark):
        written = sinks.run_to_end(rates.verdict_counts(gate.gate_stream(log, Lifetimes())).withColumn("kind", F.lit("count")))
    assert written.select("batch").distinct().count() >= 3
    gated = sequence.seq_gate(log_of(spark, rows)).filter("verdict is not null")
    got = rates.per_minute(written).select("minute", "verdict", "n").collect()
    want = reports.verdicts_per_minute(gated).select("minute", "verdict", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
