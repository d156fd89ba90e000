"""Order rows folded from applied events under a per-order sequence guard.

An applied event is accepted when its step is above every earlier one of the
same order, whichever plan it came from. Tombstones join the timeline at their
own position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v
from seqloom.operators import skew

ORDER = ["order_id"]


def with_persist_error(log: DataFrame) -> DataFrame:
    return log.withColumn(
        "persist_error",
        s.persist_error(*[F.col(c) for c in ("event_type", "order_id", "total_amount", "seq_id", "plan_id", "user_id")]),
    )


def _timeline(gated: DataFrame) -> DataFrame:
    """Applied events and tombstones the store takes, placed at (at_pos, seq_id)."""
    abort = F.col("event_type") == v.ABORT
    return (
        with_persist_error(gated)
        .filter((F.col("applied") | abort) & F.col("persist_error").isNull())
        .select(
            "order_id",
            "plan_id",
            "event_id",
            "event_type",
            "payload",
            "pos",
            abort.alias("is_abort"),
            F.when(abort, F.lit(0)).otherwise(F.col("seq_id")).alias("seq_id"),
            F.when(abort, F.col("pos")).otherwise(F.col("applied_pos")).alias("at_pos"),
            F.when(abort, F.col("ts")).otherwise(F.col("applied_ts")).alias("at_ts"),
            s.status_of_event(F.col("event_type")).alias("status"),
            F.coalesce("user_id", F.lit("unknown")).alias("user_id"),
            s.money(F.col("total_amount")).alias("total_amount"),
        )
    )


def _changes_status(last_accept: Column, last_abort: Column) -> Column:
    """A tombstone changes the row if the row exists and is not aborted already."""
    return (
        F.col("is_abort")
        & last_accept.isNotNull()
        & (last_abort.isNull() | (last_abort < last_accept))
    )


def _guard_ordinary(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*ORDER).orderBy("at_pos", "seq_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    event = ~F.col("is_abort")
    top = F.max(F.when(event, F.col("seq_id"))).over(before)
    rows = rows.withColumn("accepted", event & (top.isNull() | (F.col("seq_id") > top)))
    accepted_at = F.when(F.col("accepted"), F.col("at_pos"))
    last_accept = F.max(accepted_at).over(before)
    last_abort = F.max(F.when(F.col("is_abort"), F.col("at_pos"))).over(before)
    return rows.withColumns(
        {
            "effective": F.col("is_abort") & last_accept.isNotNull(),
            "changes_status": _changes_status(last_accept, last_abort),
            "last_at": F.max(accepted_at).over(whole),
        }
    )


def _guard_hot(rows: DataFrame) -> DataFrame:
    """Same flags, from one row per (order, step) instead of the whole timeline.

    A step is accepted, at its first application, if no higher step came before.
    """
    rows = skew.cut(rows)
    facts = (
        rows.filter(~F.col("is_abort"))
        .groupBy("order_id", "seq_id")
        .agg(F.min("at_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    facts = skew.running(
        facts,
        ORDER,
        F.floor(F.col("seq_id") / skew.SEQ_BUCKET),
        ["seq_id"],
        {"_higher": ("min", F.col("_first"))},
        descending=True,
    )
    facts = skew.cut(
        facts.withColumn(
            "_wins", F.col("_higher").isNull() | (F.col("_first") <= F.col("_higher"))
        ).drop("_higher")
    )
    # One row per hot order, hence at most skew.HOT_KEYS rows to broadcast.
    spans = facts.groupBy(*ORDER).agg(F.max(F.when(F.col("_wins"), F.col("_first"))).alias("last_at"))
    flagged = skew.spread_lookup(rows, facts, ["order_id", "seq_id"], "_n", by="at_pos")
    flagged = flagged.withColumn(
        "accepted", F.coalesce(F.col("_wins") & (F.col("at_pos") == F.col("_first")), F.lit(False))
    ).drop("_wins", "_first")
    flagged = skew.running(
        skew.chunked(skew.cut(flagged), ORDER, "at_pos"),
        ORDER,
        F.col("_chunk"),
        ["at_pos", "seq_id"],
        {
            "_last_accept": ("max", F.when(F.col("accepted"), F.col("at_pos"))),
            "_last_abort": ("max", F.when(F.col("is_abort"), F.col("at_pos"))),
        },
    )
    return (
        flagged.withColumns(
            {
                "effective": F.col("is_abort") & F.col("_last_accept").isNotNull(),
                "changes_status": _changes_status(F.col("_last_accept"), F.col("_last_abort")),
            }
        )
        .join(F.broadcast(spans), ORDER, "left")
        .drop("_last_accept", "_last_abort", "_chunk")
    )


def hot_orders(log: DataFrame) -> DataFrame | None:
    return skew.hot_keys(log, ORDER)


def order_guard(gated: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The timeline with ``accepted`` (events), ``effective`` and
    ``changes_status`` (tombstones). ``hot`` comes from ``hot_orders(log)``."""
    return skew.both(_timeline(gated), ORDER, hot, _guard_ordinary, _guard_hot)


def order_state(guarded: DataFrame) -> DataFrame:
    """Final order rows. Accepted steps only rise, so the step orders them."""
    accepted = F.col("accepted")
    step = F.when(accepted, F.col("seq_id"))
    late_abort = F.when(F.col("effective") & (F.col("at_pos") > F.col("last_at")), F.col("at_ts"))
    priced = F.when(accepted & F.col("total_amount").isNotNull(), F.col("seq_id"))
    return (
        guarded.groupBy(*ORDER)
        .agg(
            F.min_by("user_id", step).alias("user_id"),
            F.max_by("status", step).alias("_status"),
            F.max_by("total_amount", priced).alias("total_amount"),
            F.max_by("plan_id", step).alias("plan_id"),
            F.max(step).alias("last_seq_processed"),
            F.min(F.when(accepted, F.col("at_ts"))).alias("created_at"),
            F.max(F.when(accepted, F.col("at_ts"))).alias("_last_ts"),
            F.min(late_abort).alias("_abort_ts"),
        )
        .filter(F.col("last_seq_processed").isNotNull())
        .select(
            F.col("order_id").alias("id"),
            "user_id",
            F.when(F.col("_abort_ts").isNotNull(), F.lit("aborted"))
            .otherwise(F.col("_status"))
            .alias("status"),
            "total_amount",
            "plan_id",
            "last_seq_processed",
            "created_at",
            F.coalesce("_abort_ts", "_last_ts").alias("updated_at"),
        )
    )


def order_history(guarded: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The order row as a reader saw it after each accepted event."""
    rows = guarded.filter("accepted")
    out = [
        "order_id",
        "plan_id",
        "seq_id",
        "status",
        "previous_status",
        "user_id",
        "total_amount",
        "created_at",
        "updated_at",
    ]

    def finish(df: DataFrame) -> DataFrame:
        return df.select(
            "order_id",
            "plan_id",
            "seq_id",
            "status",
            F.col("_status").alias("previous_status"),
            F.coalesce("_user", "user_id").alias("user_id"),
            F.coalesce("total_amount", "_amount").alias("total_amount"),
            F.coalesce("_created", "at_ts").alias("created_at"),
            F.col("at_ts").alias("updated_at"),
        ).select(*out)

    def ordinary(df: DataFrame) -> DataFrame:
        before = Window.partitionBy(*ORDER).orderBy("seq_id").rowsBetween(
            Window.unboundedPreceding, -1
        )
        return finish(
            df.withColumns(
                {
                    "_status": F.last("status").over(before),
                    "_user": F.first("user_id").over(before),
                    "_amount": F.last("total_amount", ignorenulls=True).over(before),
                    "_created": F.first("at_ts").over(before),
                }
            )
        )

    def split(df: DataFrame) -> DataFrame:
        return finish(
            skew.running(
                df,
                ORDER,
                F.floor(F.col("seq_id") / skew.SEQ_BUCKET),
                ["seq_id"],
                {
                    "_status": ("last", F.col("status")),
                    "_user": ("first", F.col("user_id")),
                    "_amount": ("last", F.col("total_amount")),
                    "_created": ("first", F.col("at_ts")),
                },
            )
        )

    return skew.both(rows, ORDER, hot, ordinary, split)


def abort_order(guarded: DataFrame) -> DataFrame:
    """Every tombstone with what it did to its order row."""
    return guarded.filter("is_abort").select(
        "order_id", "plan_id", "event_id", "at_pos", "at_ts", "effective", "changes_status"
    )


def outbox_rows(guarded: DataFrame) -> DataFrame:
    """One row per accepted event and one per tombstone, whatever it changed."""
    return guarded.filter(F.col("accepted") | F.col("is_abort")).select(
        s.stable_uuid(F.lit("outbox"), F.col("plan_id"), F.col("event_id"), F.col("pos")).alias(
            "id"
        ),
        F.col("order_id").alias("aggregate_id"),
        "event_type",
        "payload",
        F.lit(v.OUTBOX_TOPIC).alias("topic"),
        F.lit(False).alias("processed"),
        F.col("at_ts").alias("created_at"),
    )


def db_skips(guarded: DataFrame) -> DataFrame:
    """Events the gate passed and the order guard refused."""
    return guarded.filter(~F.col("accepted") & ~F.col("is_abort"))
