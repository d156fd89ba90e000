"""Queries over the sequence gate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators import lifetimes, pipeline, sequence
from seqloom.plans.base import APPLIED, CLOCKED, EVENTS, GATE, LINEITEM, REPLAY, SESSIONS, WAITING, q
from seqloom.sources import tables

AS_OF = "2024-02-01 00:00:00"


def _events_gate(spark, sf):
    return sequence.seq_gate(tables.log_events(spark, sf))


def _lines_gate(spark, sf):
    return sequence.seq_gate(tables.log_lineitem(spark, sf))


def _sequenced(df):
    return df.filter(F.col("verdict").isNotNull())


def route_events(spark, sf):
    routed = sequence.route_events(tables.log_events(spark, sf))
    return routed.groupBy("route", "event_type").agg(F.count(F.lit(1)).alias("n"))


def seq_gate(spark, sf):
    return _sequenced(_events_gate(spark, sf)).select("plan_id", "pos", "seq_id", "verdict")


def seq_gate_lineitem(spark, sf):
    return _lines_gate(spark, sf).select("plan_id", "pos", "seq_id", "verdict")


def seq_gate_store_faults(spark, sf):
    gated = pipeline.process_log(tables.log_lineitem(spark, sf)).gated
    return gated.select("plan_id", "pos", "seq_id", "verdict")


def verdict_counts(spark, sf):
    return (
        _sequenced(_events_gate(spark, sf)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    )


def verdict_counts_lineitem(spark, sf):
    return _lines_gate(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def waiting_room(spark, sf):
    room = sequence.waiting_room(_lines_gate(spark, sf))
    return room.select("plan_id", "seq_id", "payload", "pos")


def drain(spark, sf):
    drained = sequence.applied_events(_lines_gate(spark, sf)).filter("pos <> applied_pos")
    return drained.select("plan_id", "seq_id", "payload", "applied_pos")


def applied_events(spark, sf):
    applied = sequence.applied_events(_lines_gate(spark, sf))
    return applied.select("plan_id", "seq_id", "event_id", "pos", "applied_pos")


def applied_events_store_faults(spark, sf):
    applied = sequence.applied_events(pipeline.process_log(tables.log_lineitem(spark, sf)).gated)
    return applied.select("plan_id", "seq_id", "event_id", "pos", "applied_pos")


def stale_buffered(spark, sf):
    stale = sequence.stale_buffered(_lines_gate(spark, sf))
    return stale.select("plan_id", "seq_id", "payload", "pos")


def abort_plan(spark, sf):
    gated = _events_gate(spark, sf).filter(F.col("abort_pos").isNotNull())
    wiped = (F.col("verdict") == v.OUT_OF_ORDER) & ~F.col("applied")
    return gated.groupBy("plan_id").agg(
        F.min("abort_pos").alias("abort_pos"),
        F.count_distinct(F.when(wiped, F.struct("seq_id", "payload"))).alias("wiped"),
    )


def zombie_events(spark, sf):
    zombies = sequence.zombie_events(_events_gate(spark, sf))
    return zombies.select("plan_id", "pos", "seq_id", "event_id")


def buffer_snapshot(spark, sf):
    return sequence.buffer_snapshot(
        _events_gate(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"), v.BUFFER_TTL_SECONDS
    )


def seq_counters(spark, sf):
    return sequence.seq_counters(_events_gate(spark, sf))


def gap_report(spark, sf):
    return sequence.gap_report(tables.log_lineitem(spark, sf))


def _by_the_clock(spark, sf):
    log = tables.log_sessions(spark, sf)
    return lifetimes.gate_by_the_clock(log, end=lifetimes.end_of(log, dt.timedelta(minutes=10)))


def buffer_timeout(spark, sf):
    return lifetimes.timeout_letters(_by_the_clock(spark, sf))


def abort_expiry(spark, sf):
    return lifetimes.resumed(_by_the_clock(spark, sf))


def seq_gate_by_the_clock(spark, sf):
    return _by_the_clock(spark, sf).filter("kind = 'verdict'").select("plan_id", "pos", "seq_id", "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        route_events,
        seq_gate,
        seq_gate_lineitem,
        seq_gate_store_faults,
        verdict_counts,
        verdict_counts_lineitem,
        waiting_room,
        drain,
        applied_events,
        applied_events_store_faults,
        stale_buffered,
        abort_plan,
        zombie_events,
        buffer_snapshot,
        seq_counters,
        gap_report,
        seq_gate_by_the_clock,
        buffer_timeout,
        abort_expiry,
    )
}

ORACLES = {
    "route_events": q(
        EVENTS,
        "",
        """select case when event_type = 'ABORT_PLAN' then 'abort' when seq_id is null then 'missing_seq'
           else 'sequenced' end as route, event_type, count(*) as n from ev group by all""",
    ),
    "seq_gate": q(EVENTS, GATE, "select plan_id, pos, seq_id, verdict from g"),
    "seq_gate_lineitem": q(LINEITEM, GATE, "select plan_id, pos, seq_id, verdict from g"),
    "seq_gate_store_faults": q(
        LINEITEM,
        REPLAY,
        "select plan_id, pos, arr.seq_id, verdict from run join arr using (plan_id, pos)",
    ),
    "verdict_counts": q(EVENTS, GATE, "select verdict, count(*) as n from g group by all"),
    "verdict_counts_lineitem": q(LINEITEM, GATE, "select verdict, count(*) as n from g group by all"),
    "waiting_room": q(LINEITEM, WAITING, "select plan_id, seq_id, payload, pos from wait"),
    "drain": q(
        LINEITEM,
        APPLIED,
        "select plan_id, seq_id, payload, applied_pos from ap where pos <> applied_pos",
    ),
    "applied_events": q(
        LINEITEM, APPLIED, "select plan_id, seq_id, event_id, pos, applied_pos from ap"
    ),
    "applied_events_store_faults": q(
        LINEITEM,
        REPLAY,
        """select ev.plan_id, ev.seq_id, ev.event_id, ev.pos, applied_pos
           from applied join ev on ev.plan_id = applied.plan_id and ev.pos = applied.taken""",
    ),
    "stale_buffered": q(
        LINEITEM,
        WAITING,
        "select plan_id, seq_id, payload, pos from still where applied_pos is not null",
    ),
    "abort_plan": q(
        EVENTS,
        WAITING,
        """select ab.plan_id, ab.b as abort_pos, count(w.payload) as wiped from ab left join
           (select * from wait anti join ap using (plan_id, seq_id, payload)) w using (plan_id) group by all""",
    ),
    "zombie_events": q(
        EVENTS, GATE, "select plan_id, pos, seq_id, event_id from g where verdict = 'ABORTED'"
    ),
    "buffer_snapshot": q(
        EVENTS,
        WAITING,
        """select plan_id, count(*) as members, min(still.seq_id) as min_seq, max(still.seq_id) as max_seq,
           any_value(added) as last_add,
           3600 - date_sub('second', any_value(added), timestamp '2024-02-01 00:00:00') as ttl_left
           from still join (select plan_id, max(last_ts) as added from wait group by all) using (plan_id) group by plan_id""",
    ),
    "seq_counters": q(
        EVENTS,
        GATE,
        """select plan_id, coalesce(max(rd.seq_id) filter (rd.r is not null), 0)::integer as counter
           from (select distinct plan_id from ev) left join rd using (plan_id) group by all""",
    ),
    "seq_gate_by_the_clock": q(
        SESSIONS, CLOCKED, "select plan_id, pos, arr.seq_id, verdict from run join arr using (plan_id, pos) where not tomb"
    ),
    "buffer_timeout": q(
        SESSIONS,
        CLOCKED,
        """select order_id as key, ev.plan_id, seq_id, payload, pos, 'buffer timeout: consecutive event never arrived' as error_reason,
             'BUFFER_TIMEOUT' as error_code, event_id as original_event_id
           from timed_out join ev on ev.plan_id = timed_out.plan_id and ev.pos = timed_out.gone""",
    ),
    "abort_expiry": q(
        SESSIONS,
        CLOCKED,
        """select a.plan_id, ev.seq_id, ev.pos, applied_pos from applied a join ev on ev.plan_id = a.plan_id and ev.pos = a.taken
           join (select plan_id, min(pos) as stop from ev where event_type = 'ABORT_PLAN' group by all) t on t.plan_id = a.plan_id
           where applied_pos > stop""",
    ),
    "gap_report": q(
        LINEITEM,
        "",
        """select plan_id, (p + 1)::integer as missing_from, (seq_id - 1)::integer as missing_to,
             (seq_id - p - 1)::integer as n_missing
           from (select plan_id, seq_id,
                   coalesce(lag(seq_id) over (partition by plan_id order by seq_id), 0) p
                 from (select distinct plan_id, seq_id from ev)) where seq_id > p + 1""",
    ),
}
