"""Queries over the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.operators import planner, skew
from seqloom.plans.base import PLAN_LIMIT, PLANNED, TYPE_SQL, planned, uuid_sql
from seqloom.sources import tables


def requests(spark, sf):
    return tables.orders_json(tables.order_request_texts(spark, sf))


def validated(spark, sf, limit=PLAN_LIMIT):
    return planner.plan_validate(
        planner.totals_from_array(planner.order_defaults(requests(spark, sf))), limit
    )


def planned_log(spark, sf):
    return skew.stage(planner.as_log(planner.plan_route(validated(spark, sf))))


def src_orders_json(spark, sf):
    return requests(spark, sf).select(
        "request_key", "order_id", "user_id", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), "currency"
    )


def order_defaults(spark, sf):
    return planner.order_defaults(requests(spark, sf)).select(
        "request_key", "order_id", "plan_id", "currency", "current_seq"
    )


def plan_validate(spark, sf):
    return planner.plan_validate(
        planner.totals_from_array(planner.order_defaults(requests(spark, sf)))
    ).select("order_id", "plan_id", "abort_reason", "request_error", "status")


def plan_validate_lines(spark, sf):
    """Items as a child table: the line sums never match these order totals."""
    orders = planner.order_defaults(tables.order_headers(spark, sf))
    totals = planner.totals_from_lines(orders, tables.order_lines(spark, sf))
    return (
        planner.plan_validate(totals)
        .groupBy(F.coalesce("abort_reason", F.lit("none")).alias("abort_reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def plan_route(spark, sf):
    return (
        planner.plan_route(validated(spark, sf))
        .groupBy("event_type", F.coalesce("seq_id", F.lit(0)).alias("seq_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("plan_id").alias("plans"))
    )


def plan_events(spark, sf):
    valid = validated(spark, sf).filter(F.col("abort_reason").isNull())
    data = lambda name: F.get_json_object("data", f"$.{name}").alias(name)
    return planner.plan_events(valid).select(
        "event_id",
        "event_type",
        "plan_id",
        "seq_id",
        "order_id",
        "timestamp",
        data("user_id"),
        data("currency"),
        data("warehouse_id"),
        data("reserved_until"),
        data("payment_id"),
        data("tracking_code"),
        data("estimated_delivery"),
        data("final_status"),
    )


def plan_abort_event(spark, sf):
    aborted = validated(spark, sf).filter(F.col("abort_reason").isNotNull())
    data = lambda name: F.get_json_object("data", f"$.{name}").alias(name)
    return planner.plan_abort_event(aborted).select(
        "event_id",
        "plan_id",
        "order_id",
        data("reason"),
        data("abort_code"),
        data("aborted_at_seq"),
    )


def envelope_json(spark, sf):
    """What a reader finds in the message texts: a tombstone has no step number at all."""
    events = planner.plan_route(validated(spark, sf))
    texts = events.select(planner.envelope_json(events).alias("value"))
    found = lambda path: F.get_json_object("value", f"$.{path}")
    fields = ["event_id", "event_type", "plan_id", "order_id", "timestamp", "schema_version"]
    return texts.select(
        *[found(f).alias(f) for f in fields],
        F.coalesce(found("seq_id").cast("int"), F.lit(0)).alias("seq_id"),
        F.contains("value", F.lit('"seq_id":')).alias("has_seq"),
        found("data.user_id").alias("user_id"),
    )


def make_ids(spark, sf):
    plan = F.concat(F.lit("plan_"), s.stable_hex(16, "plan", F.col("o_orderkey")))
    return tables.read(spark, sf, "orders").select(
        "o_orderkey",
        plan.alias("plan_id"),
        s.stable_uuid(F.lit("event"), plan, F.lit(1)).alias("event_id"),
        F.concat(F.lit("TRK"), F.upper(s.stable_hex(10, "tracking", plan))).alias("tracking_code"),
    )


def abort_code_of(spark, sf):
    """Reasons of refused orders, and those of later steps, told from the order's status."""
    later = F.when(F.col("o_orderstatus") == "F", "inventory_failed").when(F.col("o_orderstatus") == "O", "payment_rejected")
    rows = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("request_key"), later.alias("later"))
    reason = F.coalesce("abort_reason", "later", F.lit("unknown")).alias("reason")
    reasons = validated(spark, sf).join(rows, "request_key").select(reason)
    return reasons.groupBy("reason", s.abort_code_of(F.col("reason")).alias("abort_code")).agg(
        F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        src_orders_json,
        order_defaults,
        plan_validate,
        plan_validate_lines,
        plan_route,
        plan_events,
        plan_abort_event,
        envelope_json,
        make_ids,
        abort_code_of,
    )
}

_HEX = "substr(sha256('{salt}|' || plan_id), 1, {size})"
_WITH = f"with {PLANNED}\n"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"

ORACLES = {
    "src_orders_json": f"""with {PLANNED} select k as request_key,
        case when o_orderstatus <> 'F' and k % 97 <> 0 then order_id end as order_id,
        case when k % 97 <> 0 then user_id end as user_id, case when k % 97 <> 0 then n_items else 0 end as n_items,
        case when o_orderpriority <> '2-HIGH' and k % 97 <> 0 then 'USD' end as currency
        from req join orders on o_orderkey = k""",
    "order_defaults": _WITH + "select k as request_key, order_id, plan_id, currency, 0 as current_seq from req",
    "plan_validate": f"""with {planned(100_000)} select order_id, plan_id, abort_reason, request_error,
        case when request_error is not null then 'failed' when abort_reason is null then 'planning' else 'aborted' end as status
        from val""",
    "plan_validate_lines": """with t as (select l_orderkey, count(*) n, sum(l_quantity::integer * l_extendedprice::decimal(12,2)) s
          from lineitem group by all)
        select coalesce(case when n is null then 'items_empty' when o_totalprice <= 0 then 'invalid_amount'
          when o_totalprice > 100000 then 'amount_exceeds_limit'
          when abs(s::double - o_totalprice) > 0.01 then 'amount_mismatch' end, 'none') as abort_reason, count(*) as n
        from orders left join t on l_orderkey = o_orderkey group by 1""",
    "plan_route": _WITH + """select event_type, coalesce(seq_id, 0) as seq_id, count(*) as n,
        count(distinct plan_id) as plans from pe group by 1, 2""",
    "plan_events": _WITH
    + f"""select {uuid_sql("md5(concat_ws('|', 'event', plan_id, s))")} as event_id,
        {TYPE_SQL.format(seq="s")} as event_type, plan_id, s as seq_id, order_id,
        {_ISO.format("created")} as "timestamp",
        case when s = 1 then user_id end as user_id, case when s = 1 then currency end as currency,
        case when s = 2 then 'wh_' || {_HEX.format(salt="warehouse", size=8)} end as warehouse_id,
        case when s = 2 then {_ISO.format("created + interval 1 hour")} end as reserved_until,
        case when s = 3 then 'pay_' || {_HEX.format(salt="payment", size=8)} end as payment_id,
        case when s = 4 then 'TRK' || upper({_HEX.format(salt="tracking", size=10)}) end as tracking_code,
        case when s = 4 then {_ISO.format("created + interval 5 day")} end as estimated_delivery,
        case when s = 5 then 'delivered' end as final_status
        from val join steps on abort_reason is null and request_error is null""",
    "envelope_json": _WITH
    + f"""select event_id, event_type, plan_id, order_id, {_ISO.format("ts")} as "timestamp", '1.0' as schema_version,
        coalesce(seq_id, 0) as seq_id, event_type <> 'ABORT_PLAN' as has_seq, user_id from pe""",
    "plan_abort_event": _WITH
    + f"""select {uuid_sql("md5(concat_ws('|', 'event', plan_id, 0))")} as event_id, plan_id, order_id,
        'Validacao do plano falhou: ' || abort_reason as reason,
        'manual' as abort_code, '0' as aborted_at_seq from val where abort_reason is not null""",
    "make_ids": f"""with p as (select o_orderkey, 'plan_' || substr(sha256('plan|' || o_orderkey), 1, 16) as plan_id
          from orders)
        select o_orderkey, plan_id, {uuid_sql("md5(concat_ws('|', 'event', plan_id, 1))")} as event_id,
        'TRK' || upper({_HEX.format(salt="tracking", size=10)}) as tracking_code from p""",
    "abort_code_of": _WITH + """select reason, case when reason in ('inventory_failed', 'payment_rejected') then reason
          else 'manual' end as abort_code, count(*) as n
        from (select coalesce(abort_reason, case o_orderstatus when 'F' then 'inventory_failed' when 'O' then 'payment_rejected' end,
                'unknown') as reason from val join orders on o_orderkey = k) group by 1""",
}
