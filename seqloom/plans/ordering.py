"""Queries over order rows and the outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.operators import delivery, faults, orders, pipeline, reports
from seqloom.plans.base import EVENTS, EVENTS_TWICE, LINEITEM, SPLIT, STORE, q
from seqloom.sources import tables

ORDER_COLUMNS = (
    "id, user_id, status, total_amount::double as total_amount, plan_id, last_seq_processed, "
    "created_at, updated_at"
)
OUTBOX_COLUMNS = "id, aggregate_id, event_type, payload, topic, processed, created_at"


def _lines(spark, sf):
    return pipeline.process_log(tables.log_lineitem(spark, sf))


def _split(spark, sf):
    return pipeline.process_log(tables.log_lineitem(spark, sf, split_plans=True))


def _events(spark, sf):
    return pipeline.process_log(tables.log_events(spark, sf))


def _plain_amount(df):
    """Amounts as doubles, which both engines hand out alike."""
    return df.withColumn("total_amount", F.col("total_amount").cast("double"))


def order_guard(spark, sf):
    """Three plans may work on one order here."""
    guarded = _split(spark, sf).guarded
    return guarded.select("order_id", "plan_id", "seq_id", "at_pos", "accepted")


def order_state(spark, sf):
    return _plain_amount(_lines(spark, sf).orders)


def order_state_events(spark, sf):
    return _plain_amount(_events(spark, sf).orders)


def order_state_split_plans(spark, sf):
    return _plain_amount(_split(spark, sf).orders)


def order_history(spark, sf):
    return _plain_amount(_split(spark, sf).history)


def abort_order(spark, sf):
    return orders.abort_order(_events(spark, sf).guarded)


def outbox_rows(spark, sf):
    return _events(spark, sf).outbox


def db_skips(spark, sf):
    skips = orders.db_skips(_split(spark, sf).guarded)
    return skips.select("order_id", "plan_id", "seq_id", "event_id", "at_pos")


def replay_idempotence(spark, sf):
    """Send everything twice: rows whose state differs (none) and how many agree."""
    log = tables.log_events(spark, sf)
    once, twice = pipeline.process_log(log).orders, pipeline.process_log(faults.resend_all(log)).orders
    changed = reports.state_changes(once, twice)
    return once.select(F.lit("orders").alias("side")).unionByName(changed.select("side")).groupBy(
        "side"
    ).agg(F.count(F.lit(1)).alias("n"))


def status_domain_check(spark, sf):
    """Statuses as the log of order lines names them: types 6 and 7 lead to none."""
    log = tables.log_lineitem(spark, sf)
    named = log.select(F.col("event_id").alias("id"), s.status_of_event(F.col("event_type")).alias("status"))
    return reports.status_domain_check(named).select("id", "status")


def outbox_next_batch(spark, sf):
    return delivery.outbox_next_batch(_events(spark, sf).outbox)


def outbox_mark(spark, sf):
    """Receipts exist for everything but tombstones."""
    outbox = _events(spark, sf).outbox
    receipts = outbox.filter("event_type <> 'ABORT_PLAN'")
    marked = delivery.outbox_mark(outbox, receipts)
    return marked.groupBy("event_type", "processed").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        order_guard,
        order_state,
        order_state_events,
        order_state_split_plans,
        order_history,
        abort_order,
        outbox_rows,
        db_skips,
        replay_idempotence,
        status_domain_check,
        outbox_next_batch,
        outbox_mark,
    )
}

ORACLES = {
    "order_guard": q(
        SPLIT,
        STORE,
        """select tl.order_id, tl.plan_id, tl.seq_id, tl.at_pos, acc.order_id is not null as accepted
           from tl left join acc using (order_id, plan_id, seq_id, at_pos)""",
    ),
    "order_state": q(LINEITEM, STORE, f"select {ORDER_COLUMNS} from ord"),
    "order_state_events": q(EVENTS, STORE, f"select {ORDER_COLUMNS} from ord"),
    "order_state_split_plans": q(SPLIT, STORE, f"select {ORDER_COLUMNS} from ord"),
    "order_history": q(
        SPLIT,
        STORE,
        """select order_id, plan_id, seq_id, status, lag(status) over w as previous_status,
             first_value(user_id) over w as user_id, (last_value(total_amount ignore nulls) over w)::double as total_amount,
             first_value(at_ts) over w as created_at, at_ts as updated_at
           from acc window w as (partition by order_id order by seq_id)""",
    ),
    "abort_order": q(
        EVENTS, STORE, "select order_id, plan_id, event_id, at_pos, at_ts, effective, changes_status from abt"
    ),
    "outbox_rows": q(EVENTS, STORE, f"select {OUTBOX_COLUMNS} from obx"),
    "db_skips": q(
        SPLIT,
        STORE,
        """select order_id, plan_id, seq_id, event_id, at_pos from tl
           anti join acc using (order_id, plan_id, seq_id, at_pos)""",
    ),
    "replay_idempotence": f"""with recursive a as ({q(EVENTS, STORE, "select * from ord")}),
      b as ({q(EVENTS_TWICE, STORE, "select * from ord")}),
      ka as (select id, user_id, status, total_amount, plan_id, last_seq_processed from a),
      kb as (select id, user_id, status, total_amount, plan_id, last_seq_processed from b)
      select 'orders' as side, count(*) as n from ka
      union all select 'before', count(*) from (select * from ka except all select * from kb) having count(*) > 0
      union all select 'after', count(*) from (select * from kb except all select * from ka) having count(*) > 0""",
    "status_domain_check": q(
        LINEITEM, "", "select event_id as id, '' as status from ev where event_type in ('Unknown6', 'Unknown7')"
    ),
    "outbox_next_batch": q(
        EVENTS, STORE, f"select {OUTBOX_COLUMNS} from obx where not processed order by created_at, id limit 50"
    ),
    "outbox_mark": q(
        EVENTS,
        STORE,
        """select event_type, event_type <> 'ABORT_PLAN' as processed, count(*) as n from obx group by all""",
    ),
}
