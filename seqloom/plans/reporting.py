"""Verification queries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators import faults, pipeline, reports, sequence
from seqloom.plans import planning
from seqloom.plans.base import EVENTS, GATE, LINEITEM, PLANNED, STORE, WAITING, q
from seqloom.sources import tables


def _planned(spark, sf):
    return pipeline.process_log(planning.planned_log(spark, sf))


def _audit(spark, sf):
    return reports.audit_events(sequence.seq_gate(tables.log_events(spark, sf)))


def completed_count(spark, sf):
    """Of the urgent and high orders only."""
    wanted = planning.validated(spark, sf).join(
        tables.read(spark, sf, "orders")
        .filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .select(F.col("o_orderkey").alias("request_key")),
        "request_key",
        "left_semi",
    )
    return reports.completed_count(_planned(spark, sf).orders, wanted.select(F.col("order_id").alias("id")))


def outbox_duplicates(spark, sf):
    """Tombstones sent again add outbox rows; nothing else does."""
    log = faults.resend_all(tables.log_events(spark, sf))
    return reports.outbox_duplicates(pipeline.process_log(log).outbox)


def incomplete_orders(spark, sf):
    log = tables.log_lineitem(spark, sf)
    return reports.incomplete_orders(pipeline.process_log(log).orders)


def e2e_report(spark, sf):
    log = planning.planned_log(spark, sf)
    done = pipeline.process_log(log)
    return reports.e2e_report(log, done.orders, done.outbox)


def plan_duplicates(spark, sf):
    """One plan per supplier and day here names many orders."""
    return reports.plan_duplicates(
        tables.read(spark, sf, "lineitem").select(
            F.concat_ws("_", F.lit("plan"), "l_suppkey", F.col("l_shipdate").cast("date")).alias("plan_id")
        )
    )


def partial_progress(spark, sf):
    return reports.partial_progress(pipeline.process_log(tables.log_lineitem(spark, sf)).orders)


def gap_scenario_check(spark, sf):
    """All order rows of the order lines: late steps, gaps and refusals are the table's own."""
    return reports.gap_scenario_check(pipeline.process_log(tables.log_lineitem(spark, sf)).orders)


def zombie_check(spark, sf):
    """All order rows of the click stream, which the table's own errors abort, or do not."""
    return reports.zombie_check(pipeline.process_log(tables.log_events(spark, sf)).orders)


def recent_orders(spark, sf):
    return reports.recent_orders(pipeline.process_log(tables.log_events(spark, sf)).orders)


def recent_outbox(spark, sf):
    return reports.recent_outbox(pipeline.process_log(tables.log_events(spark, sf)).outbox)


def audit_events(spark, sf):
    return _audit(spark, sf)


def trace_search(spark, sf):
    return reports.trace_search(_audit(spark, sf), "order-server", "process-event")


def trace_search_by_tag(spark, sf):
    return reports.trace_search(_audit(spark, sf), "order-server", event_type=v.ABORT)


def plan_outcome_rate(spark, sf):
    return reports.plan_outcome_rate(_planned(spark, sf).orders)


def verdicts_per_minute(spark, sf):
    gated = sequence.seq_gate(tables.log_events(spark, sf))
    return reports.verdicts_per_minute(gated.filter(F.col("verdict").isNotNull()))


def unresolved_buffers(spark, sf):
    return reports.unresolved_buffers(sequence.seq_gate(tables.log_lineitem(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        completed_count,
        outbox_duplicates,
        incomplete_orders,
        e2e_report,
        plan_duplicates,
        partial_progress,
        gap_scenario_check,
        zombie_check,
        recent_orders,
        recent_outbox,
        audit_events,
        trace_search,
        trace_search_by_tag,
        plan_outcome_rate,
        verdicts_per_minute,
        unresolved_buffers,
    )
}

_AUDIT = f"""{GATE},
au as (select 'order-server' as service, 'process-event' as operation, ev.event_type, ev.plan_id, ev.order_id,
    ev.pos, ev.ts, md5(ev.plan_id) as trace_id, substr(md5(ev.event_id), 1, 16) as span_id, g.verdict,
    coalesce(dr.n, 0) as drained,
    case when ev.event_type = 'ABORT_PLAN' then 'error' else 'ok' end as status
  from ev left join g using (plan_id, pos) left join (select plan_id, r as pos, count(*) - 1 as n from rd
    where r is not null group by all) dr using (plan_id, pos))"""

ORACLES = {
    "completed_count": q(
        PLANNED,
        STORE,
        """select count(*) as completed from ord where status = 'completed' and last_seq_processed = 5
           and id in (select order_id from req join orders on o_orderkey = k
                      where o_orderpriority in ('1-URGENT', '2-HIGH'))""",
    ),
    "outbox_duplicates": q(
        EVENTS,
        STORE,
        """select aggregate_id, event_type, 2 * count(*) as n from obx where event_type = 'ABORT_PLAN' group by all""",
    ),
    "incomplete_orders": q(
        LINEITEM,
        STORE,
        """select id, status, last_seq_processed from ord
           where status <> 'completed' or last_seq_processed <> 5""",
    ),
    "e2e_report": q(
        PLANNED,
        "",
        """select p.*, d.*, 0::bigint as outbox_duplicates,
             date_diff('second', f, l) as elapsed_seconds,
             (date_diff('second', f, l) * 1000 // plans_sent)::bigint as ms_per_plan,
             case when plans_sent = plans_completed then 'exactly_once' else 'failed' end as result
           from (select count(distinct plan_id) as plans_sent, count(*) as events_sent from ev) p,
             (select count(distinct plan_id) as plans_completed from ev where seq_id = 5) d,
             (select min(ts) f, max(ts) filter (seq_id = 5) l from ev)""",
    ).replace("select p.*, d.*,", "select p.plans_sent, p.events_sent, d.plans_completed,"),
    "plan_duplicates": """select concat_ws('_', 'plan', l_suppkey, l_shipdate::date) as plan_id, count(*) as n
        from lineitem group by 1 having count(*) > 1""",
    "partial_progress": q(
        LINEITEM,
        STORE,
        "select count(*) as total, count(*) filter (last_seq_processed >= 2) as progressed from ord",
    ),
    "gap_scenario_check": q(
        LINEITEM,
        STORE,
        """select count(*) as total, count(*) filter (status = 'completed' and last_seq_processed = 5) as completed,
           count(*) = count(*) filter (status = 'completed' and last_seq_processed = 5) as passed from ord""",
    ),
    "zombie_check": q(
        EVENTS,
        STORE,
        """select count(*) as total, count(*) filter (status = 'aborted') as aborted,
           count(*) = count(*) filter (status = 'aborted') as passed from ord""",
    ),
    "recent_orders": q(
        EVENTS,
        STORE,
        """select id, status, last_seq_processed, updated_at from ord
           order by updated_at desc, id limit 5""",
    ),
    "recent_outbox": q(
        EVENTS,
        STORE,
        "select id, event_type, processed, created_at from obx order by created_at desc, id limit 5",
    ),
    "audit_events": q(EVENTS, _AUDIT, "select * from au"),
    "trace_search": q(EVENTS, _AUDIT, "select * from au order by ts desc, span_id, pos limit 20"),
    "trace_search_by_tag": q(
        EVENTS,
        _AUDIT,
        "select * from au where event_type = 'ABORT_PLAN' order by ts desc, span_id, pos limit 20",
    ),
    "plan_outcome_rate": q(
        PLANNED,
        STORE,
        """select count(*) as orders, count(*) filter (status = 'completed') as completed,
             count(*) filter (status = 'aborted') as aborted,
             round(count(*) filter (status = 'completed') / greatest(count(*), 1), 6) as completed_rate,
             round(count(*) filter (status = 'aborted') / greatest(count(*), 1), 6) as aborted_rate from ord""",
    ),
    "verdicts_per_minute": q(
        EVENTS,
        GATE,
        "select date_trunc('minute', ts) as minute, verdict, count(*) as n from g group by all",
    ),
    "unresolved_buffers": q(
        LINEITEM,
        WAITING,
        "select count(distinct plan_id) as plans, count(*) as events from still",
    ),
}
