"""Streaming queries: the click-stream log run to its end through keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators import lifetimes, skew
from seqloom.operators.replay import Lifetimes
from seqloom.plans import ordering, reporting, sequencing, wiring
from seqloom.sources import messages, tables, wire
from seqloom.streaming import gate, inspect, ledger, rates, sinks


# Rows of a file that a slice of a table is written in.
FILE_ROWS = 100_000


def _forever(spark, sf):
    return sinks.run_gate(tables.log_events(spark, sf, stream=True), Lifetimes())


def stream_gate(spark, sf):
    written = _forever(spark, sf).filter("kind = 'verdict'")
    return written.select("plan_id", "pos", "seq_id", "verdict")


def src_event_log(spark, sf):
    """The raw log consumed as a stream, parsed, and written batch by batch."""
    typed = wire.typed_rows(wire.parse_envelope(messages.raw_events(spark, sf, stream=True)))
    kind = F.when(F.col("parse_ok"), F.lit("event")).otherwise(F.lit("unread"))
    written = sinks.run_to_end(typed.withColumn("kind", kind))
    return written.select(
        "pos", "kind", F.coalesce("event_type", F.lit("-")).alias("event_type")
    )


def _in_slices(df, name, parts=3):
    """A table as a stream of several micro-batches: slices by position, equally many files each, those of one a trigger."""
    folder = sinks.scratch(df.sparkSession)
    df = skew.stage(df)
    cuts = df.approxQuantile("pos", [i / parts for i in range(1, parts)], 0.01)
    at = F.lit(0)
    for c in cuts:
        at = at + F.when(F.col("pos") > c, 1).otherwise(0)
    counts = {r["at"]: r["count"] for r in df.groupBy(at.alias("at")).count().collect()}  # a row per slice
    # Rows are dealt out in turn, and of so few files to so many rows none stays empty.
    files = max(1, min(counts.get(i, 0) for i in range(parts)) // FILE_ROWS)
    for i in range(parts):
        df.filter(at == i).repartition(files).write.mode("append").parquet(f"{folder}/{name}")
    stream = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
    return stream.parquet(f"{folder}/{name}")


def _ledger(spark, sf):
    log = _in_slices(tables.log_events(spark, sf), "log")
    with sinks.rocksdb(spark):
        return ledger.run(ledger.order_pipeline(log, Lifetimes()), sinks.scratch(spark))


def sink_orders(spark, sf):
    return _ledger(spark, sf).orders().withColumn("total_amount", F.col("total_amount").cast("double"))


def sink_outbox(spark, sf):
    return _ledger(spark, sf).outbox()


def stream_dead_letters(spark, sf):
    """One stream from raw records to letters. Plans live for a day here, so nothing times out before its time."""
    typed = wire.typed_rows(wire.parse_envelope(messages.raw_events(spark, sf)))
    with sinks.rocksdb(spark):
        kept = ledger.run(ledger.pipeline(_in_slices(typed, "records"), Lifetimes()), sinks.scratch(spark))
    return kept.letters().select("pos", "key", "raw", "error_code", "error_reason", "original_event_id")


def _clocked(spark, sf):
    return sinks.run_gate(tables.log_sessions(spark, sf, stream=True))


def stream_buffer_timeout(spark, sf):
    return sinks.timeout_letters(_clocked(spark, sf))


def stream_abort_expiry(spark, sf):
    """Events applied to plans although a tombstone had stopped them a day before."""
    return lifetimes.resumed(_clocked(spark, sf))


def stream_verdict_rate(spark, sf):
    """Verdicts per minute of a log in several micro-batches, each amending the counts of those before."""
    log = _in_slices(tables.log_events(spark, sf), "log")
    with sinks.rocksdb(spark):
        written = sinks.run_to_end(rates.verdict_counts(gate.gate_stream(log, Lifetimes())).withColumn("kind", F.lit("count")))
    return rates.per_minute(written)


def _checkpoint(spark, sf):
    """The click-stream log run to its end; where its state lies."""
    folder = sinks.scratch(spark)
    with sinks.rocksdb(spark):
        out = gate.gate_stream(tables.log_events(spark, sf, stream=True), Lifetimes())
        sinks.write_batches(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/checkpoint"


def state_buffer_snapshot(spark, sf):
    as_of = F.lit(sequencing.AS_OF).cast("timestamp_ntz")
    return inspect.buffer_snapshot(spark, _checkpoint(spark, sf), as_of, v.BUFFER_TTL_SECONDS)


def state_seq_counters(spark, sf):
    return inspect.seq_counters(spark, _checkpoint(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (src_event_log, stream_gate, sink_orders, sink_outbox, stream_dead_letters, stream_buffer_timeout, stream_abort_expiry, stream_verdict_rate, state_buffer_snapshot, state_seq_counters)
}
ORACLES = {
    "stream_gate": sequencing.ORACLES["seq_gate"],
    "sink_orders": ordering.ORACLES["order_state_events"],
    "sink_outbox": ordering.ORACLES["outbox_rows"],
    "stream_verdict_rate": reporting.ORACLES["verdicts_per_minute"],
    "state_buffer_snapshot": sequencing.ORACLES["buffer_snapshot"],
    "state_seq_counters": sequencing.ORACLES["seq_counters"],
    "stream_buffer_timeout": sequencing.ORACLES["buffer_timeout"],
    "stream_abort_expiry": sequencing.ORACLES["abort_expiry"],
    "stream_dead_letters": f"""with letters as ({wiring.ORACLES["sink_dlq"]}), unread as ({wiring.ORACLES["sink_dlq_raw"]})
        select pos, key, null::varchar as raw, error_code, error_reason, original_event_id from letters
        union all select pos, null, raw, error_code, error_reason, null from unread""",
    "src_event_log": f"""select pos, case when parse_ok then 'event' else 'unread' end as kind, event_type
        from ({wiring.ORACLES["parse_envelope"]})""",
}
