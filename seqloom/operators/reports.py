"""Exactly-once checks and reports over order rows, outbox, verdicts and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v
from seqloom.operators import faults, sequence

DONE = f"status = 'completed' AND last_seq_processed = {v.FINAL_SEQ}"


def completed_count(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """Completed orders among the given ids (column ``id``)."""
    return (
        orders.join(ids.select("id"), "id", "left_semi")
        .filter(DONE)
        .agg(F.count(F.lit(1)).alias("completed"))
    )


def incomplete_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(f"NOT ({DONE})").select("id", "status", "last_seq_processed")


def outbox_duplicates(outbox: DataFrame) -> DataFrame:
    return (
        outbox.groupBy("aggregate_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def plan_duplicates(orders: DataFrame) -> DataFrame:
    return orders.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def partial_progress(orders: DataFrame, at_least: int = 2) -> DataFrame:
    return orders.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("last_seq_processed") >= at_least).alias("progressed"),
    )


def gap_scenario_check(orders: DataFrame) -> DataFrame:
    """Everything completed although a step came late?"""
    counts = orders.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.expr(DONE)).alias("completed")
    )
    return counts.withColumn("passed", F.col("total") == F.col("completed"))


def zombie_check(orders: DataFrame) -> DataFrame:
    """Everything aborted, no zombie applied?"""
    counts = orders.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "aborted").alias("aborted"),
    )
    return counts.withColumn("passed", F.col("total") == F.col("aborted"))


def e2e_report(log: DataFrame, orders: DataFrame, outbox: DataFrame) -> DataFrame:
    """One row: sent, completed, twins, elapsed, verdict.

    Three one-row aggregates, put together by a union instead of a join.
    """
    twins = outbox_duplicates(outbox).agg(F.count(F.lit(1)).alias("outbox_duplicates"))
    sent = log.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    sent = sent.agg(
        F.count(F.lit(1)).alias("plans_sent"),
        F.sum("n").alias("events_sent"),
        F.min("first").alias("first_ts"),
    )
    done = orders.filter(DONE).agg(
        F.count(F.lit(1)).alias("plans_completed"), F.max("updated_at").alias("last_ts")
    )
    parts = sent.unionByName(done, allowMissingColumns=True).unionByName(
        twins, allowMissingColumns=True
    )
    total = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    elapsed = F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts"))
    whole = (F.col("plans_completed") == F.col("plans_sent")) & (F.col("outbox_duplicates") == 0)
    return total.select(
        "plans_sent",
        "events_sent",
        "plans_completed",
        "outbox_duplicates",
        elapsed.alias("elapsed_seconds"),
        F.floor(elapsed * 1000 / F.greatest("plans_sent", F.lit(1))).alias("ms_per_plan"),
        F.when(whole, F.lit("exactly_once")).otherwise(F.lit("failed")).alias("result"),
    )


def recent_orders(orders: DataFrame, n: int = 5) -> DataFrame:
    newest = orders.orderBy(F.desc("updated_at"), "id").limit(n)
    return newest.select("id", "status", "last_seq_processed", "updated_at")


def recent_outbox(outbox: DataFrame, n: int = 5) -> DataFrame:
    newest = outbox.orderBy(F.desc("created_at"), "id").limit(n)
    return newest.select("id", "event_type", "processed", "created_at")


def audit_events(gated: DataFrame) -> DataFrame:
    """One span row per received event, with verdict and number of drained events."""
    drained = (
        gated.filter("applied AND pos <> applied_pos")
        .groupBy("plan_id", F.col("applied_pos").alias("pos"))
        .agg(F.count(F.lit(1)).alias("drained"))
    )
    # One row per (plan, position) on either side: nothing to skew.
    spans = gated.join(drained, ["plan_id", "pos"], "left")
    header = s.traceparent(F.md5("plan_id"), F.substring(F.md5("event_id"), 1, 16))
    return spans.select(
        F.lit("order-server").alias("service"),
        F.lit("process-event").alias("operation"),
        "event_type",
        "plan_id",
        "order_id",
        "pos",
        "ts",
        s.trace_id_of(header).alias("trace_id"),
        s.span_id_of(header).alias("span_id"),
        "verdict",
        F.coalesce("drained", F.lit(0)).alias("drained"),
        F.when(F.col("event_type") == v.ABORT, F.lit("error")).otherwise("ok").alias("status"),
    )


def record_spans(received: DataFrame, gated: DataFrame) -> DataFrame:
    """The spans of every received record, readable or not: one for the record, and one for each event that its arrival
    drained from the waiting room, as its child.

    ``received`` has pos, ts, the ids of the sender's span (``trace_id``, ``parent_id``), ``reject`` (the error code of
    what never gets to the gate), event_type and plan_id; ``gated`` is the gated log of the rest. Positions are unique, so
    no join here meets a key twice.
    """
    own = lambda kind, pos: F.substring(F.md5(F.concat_ws("|", F.lit(kind), F.col(pos).cast("string"))), 1, 16)
    verdicts = gated.select("pos", "verdict")
    tombstone = F.col("event_type") == v.ABORT
    records = received.join(verdicts, "pos", "left").select(
        F.lit("process-event").alias("operation"),
        "pos",
        "ts",
        "trace_id",
        own("record", "pos").alias("span_id"),
        "parent_id",
        "event_type",
        "plan_id",
        F.coalesce("reject", "verdict").alias("result"),
        F.when(F.col("reject").isNotNull() | tombstone, F.lit("error")).otherwise("ok").alias("status"),
    )
    drained = gated.filter("applied AND pos <> applied_pos").select(
        F.col("pos").alias("_member"), F.col("event_type").alias("_type"), F.col("plan_id").alias("_plan"), "persist_error", F.col("applied_pos").alias("pos")
    )
    children = drained.join(received.select("pos", "ts", "trace_id"), "pos").select(
        F.lit("drain-event").alias("operation"),
        F.col("_member").alias("pos"),
        "ts",
        "trace_id",
        own("drain", "_member").alias("span_id"),
        own("record", "pos").alias("parent_id"),
        F.col("_type").alias("event_type"),
        F.col("_plan").alias("plan_id"),
        F.lit(None).cast("string").alias("result"),
        F.when(F.col("persist_error").isNotNull(), F.lit("error")).otherwise("ok").alias("status"),
    )
    return records.unionByName(children)


def trace_search(
    audit: DataFrame, service: str, operation: str | None = None, n: int = 20, **tags: str
) -> DataFrame:
    """Latest spans of a service, by operation and tags (``event_type="ABORT_PLAN"``)."""
    found = audit.filter(F.col("service") == service)
    if operation is not None:
        found = found.filter(F.col("operation") == operation)
    for name, value in tags.items():
        found = found.filter(F.col(name) == value)
    return found.orderBy(F.desc("ts"), "span_id", "pos").limit(n)


def plan_outcome_rate(orders: DataFrame) -> DataFrame:
    counts = orders.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "aborted").alias("aborted"),
    )
    share = lambda c: F.round(F.col(c) / F.greatest("orders", F.lit(1)), 6)
    return counts.withColumns(
        {"completed_rate": share("completed"), "aborted_rate": share("aborted")}
    )


def verdicts_per_minute(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.date_trunc("minute", "ts").alias("minute"), "verdict").agg(
        F.count(F.lit(1)).alias("n")
    )


def status_domain_check(orders: DataFrame) -> DataFrame:
    """Rows whose status is outside the domain; must be empty."""
    return orders.filter(~F.col("status").isin(v.ORDER_STATUSES))


def replica_states(log: DataFrame, replica: Column | None = None) -> DataFrame:
    """Last contiguous step per (replica, order) when events reach only one replica each."""
    replica = faults.replica_of(F.col("event_id")) if replica is None else replica
    keyed = log.withColumn("plan_id", F.concat(replica, F.lit("/"), F.col("order_id")))
    counters = sequence.seq_counters(sequence.seq_gate(keyed)).filter("counter > 0")
    return counters.select(
        F.substring_index("plan_id", "/", 1).alias("replica"),
        F.substring_index("plan_id", "/", -1).alias("order_id"),
        F.col("counter").alias("last_seq"),
    )


def replica_divergence(states: DataFrame) -> DataFrame:
    """Orders the two replicas disagree on; null where a replica has no state."""
    side = lambda name: F.max(F.when(F.col("replica") == name, F.col("last_seq")))
    wide = states.groupBy("order_id").agg(
        side("alpha").alias("alpha_seq"), side("beta").alias("beta_seq")
    )
    return wide.filter(~F.col("alpha_seq").eqNullSafe(F.col("beta_seq")))


def unresolved_buffers(gated: DataFrame) -> DataFrame:
    left = sequence.still_buffered(gated).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    return left.agg(
        F.count(F.lit(1)).alias("plans"), F.coalesce(F.sum("n"), F.lit(0)).alias("events")
    )


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Order rows that differ between two runs, with the side they are on."""
    columns = ["id", "user_id", "status", "total_amount", "plan_id", "last_seq_processed"]
    a, b = before.select(*columns), after.select(*columns)
    lost = a.exceptAll(b).withColumn("side", F.lit("before"))
    return lost.unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))
