"""Plans and orders as entries of a bucket's state; slices of several files."""

from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators import sequence
from seqloom.operators.replay import Lifetimes, step
from seqloom.plans import streams
from seqloom.sources import tables
from seqloom.streaming import gate, inspect, sinks
from tests import literal
from tests.literal import event, log_of, steps, uid


class Entries:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, []

    def containsKey(self, key):
        self.calls.append("contains")
        return key in self.held

    def getValue(self, key):
        self.calls.append("get")
        return self.held[key]

    def updateValue(self, key, value):
        self.calls.append("update")
        self.held[key] = value


def test_a_plan_is_read_and_written_once(spark):
    plans, apart = Entries(), Entries()
    events = [tuple(r) for r in log_of(spark, steps(4, 3, 2, 1, 2)).withColumn("persist_error", F.lit(None).cast("string")).select(*gate.FIELDS).collect()]
    for part, reads in ((events[:3], ["contains"]), (events[3:], ["contains", "get"])):
        plans.calls.clear()
        plan = gate._PlanInState("plan_a", plans, apart, apart)
        for carried in part:
            step(plan, gate._arrival(carried))
        plan.save()
        assert plans.calls == [*reads, "update"]
    assert apart.calls == []
    assert plans.held[("plan_a",)][0] == 4


def test_large_waiting_rooms(spark, tmp_path):
    """More members than a plan's value holds: drained, emptied by a tombstone, and kept."""
    n = 2 * gate.ROOM
    folder, plans = str(tmp_path / "in"), ("plan_drained", "plan_aborted", "plan_kept", "plan_other")
    late = [(plan, uid(k), seq) for k, plan in enumerate(plans) for seq in range(n, 1, -1)]
    rows = [event(pos, *place) for pos, place in enumerate(late, 1)]
    more = [event(len(rows) + 1, "plan_drained", uid(0), 1), event(len(rows) + 2, "plan_aborted", uid(1), None, v.ABORT)]
    for part in (rows, more):
        log_of(spark, part).coalesce(1).write.mode("append").parquet(folder)
    log = spark.readStream.schema(literal.LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    checkpoint = str(tmp_path / "checkpoint")
    with sinks.rocksdb(spark):
        sinks.write_batches(gate.gate_stream(log, Lifetimes()), str(tmp_path / "out"), checkpoint).awaitTermination()
    gated = sequence.seq_gate(log_of(spark, rows + more))
    written = spark.read.parquet(str(tmp_path / "out"))
    got = written.filter("kind = 'verdict'").select("pos", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, gated.filter("verdict is not null").select("pos", "verdict").collect()))
    assert written.filter("kind = 'applied'").count() == n
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    want = sequence.buffer_snapshot(gated, as_of, 3600).select("plan_id", "members", "min_seq", "max_seq", "last_add", "ttl_left")
    assert want.count() == 2
    found = inspect.buffer_snapshot(spark, checkpoint, as_of, 3600).select(want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_slices_of_several_files(spark, tmp_path, monkeypatch):
    """Every micro-batch is one slice, whatever the number of its files."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    log = tables.log_events(spark, "/root/testdata/sf0.01").filter("pos < 2000")
    written = sinks.run_to_end(streams._in_slices(log, "log").select("pos", F.lit("row").alias("kind"), F.input_file_name().alias("file")))
    seen = written.groupBy("batch").agg(F.min("pos"), F.max("pos"), F.count_distinct("file"), F.count("pos")).orderBy("batch").collect()
    assert len(seen) == 3 and sum(r[4] for r in seen) == 2000
    assert len({r[3] for r in seen}) == 1 and seen[0][3] >= 5
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
