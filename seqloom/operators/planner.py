"""From order requests to event plans: defaults, rules, five events or one tombstone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v


def order_defaults(requests: DataFrame) -> DataFrame:
    """Fill order id, plan id, currency and start state. ``request_key`` is what
    ids derive from, so that a retried task names the same plan again."""
    key = F.col("request_key")
    return requests.withColumns(
        {
            "order_id": F.coalesce("order_id", s.stable_uuid(F.lit("order"), key)),
            "plan_id": F.concat(F.lit("plan_"), s.stable_hex(16, "plan", key)),
            "currency": F.coalesce("currency", F.lit(v.DEFAULT_CURRENCY)),
            "current_seq": F.lit(0),
        }
    )


def totals_from_array(orders: DataFrame) -> DataFrame:
    """``n_items`` and ``calculated`` from the items array of the row itself."""
    line = lambda acc, i: acc + i["quantity"] * i["unit_price"]
    return orders.withColumns(
        {
            "n_items": F.coalesce(F.size("items"), F.lit(0)),
            "calculated": F.aggregate(
                F.coalesce("items", F.expr("array()").cast(orders.schema["items"].dataType)),
                F.lit(0.0),
                line,
            ),
        }
    )


def totals_from_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The same from a table of lines ``(order_id, quantity, unit_price)``,
    summed map-side before the join, so that no order is gathered whole."""
    totals = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(F.col("quantity") * F.col("unit_price")).alias("calculated"),
    )
    joined = orders.join(totals, "order_id", "left")
    return joined.withColumns(
        {
            "n_items": F.coalesce("n_items", F.lit(0)),
            "calculated": F.coalesce("calculated", F.lit(0)),
        }
    )


def request_error(orders: DataFrame) -> Column:
    """Why no event at all can be made of a request: what the event models refuse before anything is sent."""
    unreadable = F.col("unreadable") if "unreadable" in orders.columns else F.lit(False)
    out = F.when(unreadable, F.lit("unreadable")).when(F.col("total_amount").isNull(), F.lit("no_total"))
    if "items" in orders.columns:
        bad = lambda i: i.isNull() | i["quantity"].isNull() | i["unit_price"].isNull()
        out = out.when(F.exists("items", bad), F.lit("item_incomplete"))
    return out


def model_error(orders: DataFrame) -> Column:
    """Item values that the rules let through and the event models do not."""
    if "items" not in orders.columns:
        return F.lit(None).cast("string")
    wrong = lambda i: (i["quantity"] < 1) | (i["unit_price"] < 0)
    return F.when(F.exists("items", wrong), F.lit("item_invalid"))


def plan_validate(orders: DataFrame, limit: float = v.ORDER_MAX_AMOUNT) -> DataFrame:
    """Add ``abort_reason`` (first failing rule, or null), ``request_error`` and ``status``.

    A request in error is neither planned nor aborted: no event is made of it.
    """
    total = F.col("total_amount")
    reason = (
        F.when(F.col("n_items") == 0, F.lit("items_empty"))
        .when(total <= 0, F.lit("invalid_amount"))
        .when(total > limit, F.lit("amount_exceeds_limit"))
        .when(F.abs(F.col("calculated") - total) > v.AMOUNT_TOLERANCE, F.lit("amount_mismatch"))
    )
    broken = request_error(orders)
    judged = orders.withColumn("abort_reason", F.when(broken.isNull(), reason))
    error = F.coalesce(broken, F.when(F.col("abort_reason").isNull(), model_error(orders)))
    return judged.withColumn("request_error", error).withColumn(
        "status",
        F.when(F.col("request_error").isNotNull(), F.lit("failed"))
        .when(F.col("abort_reason").isNull(), F.lit("planning"))
        .otherwise("aborted"),
    )


def _iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _event(seq: Column, kind: str, payload: Column) -> Column:
    return F.struct(
        seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), F.to_json(payload).alias("data")
    )


def _five_events(has_items: bool) -> Column:
    plan, created = F.col("plan_id"), F.col("created")
    items = [F.col("items")] if has_items else []
    payloads = [
        F.struct("user_id", *items, "total_amount", "currency"),
        F.struct(
            F.concat(F.lit("wh_"), s.stable_hex(8, "warehouse", plan)).alias("warehouse_id"),
            F.lit(True).alias("all_items_available"),
            _iso(created + F.expr("INTERVAL 1 HOUR")).alias("reserved_until"),
        ),
        F.struct(
            F.concat(F.lit("pay_"), s.stable_hex(8, "payment", plan)).alias("payment_id"),
            F.lit("credit_card").alias("method"),
            F.col("total_amount").alias("amount"),
            F.lit("approved").alias("status"),
        ),
        F.struct(
            F.concat(F.lit("TRK"), F.upper(s.stable_hex(10, "tracking", plan))).alias(
                "tracking_code"
            ),
            F.lit("correios").alias("carrier"),
            _iso(created + F.expr("INTERVAL 5 DAYS")).alias("estimated_delivery"),
        ),
        F.struct(_iso(created).alias("completed_at"), F.lit("delivered").alias("final_status")),
    ]
    steps = enumerate(zip(v.SEQUENCED_TYPES, payloads, strict=True), 1)
    return F.array(*[_event(F.lit(seq), kind, payload) for seq, (kind, payload) in steps])


def _tombstone() -> Column:
    payload = F.struct(
        F.concat(F.lit(v.ABORT_REASON_PREFIX), F.col("abort_reason")).alias("reason"),
        s.abort_code_of(F.col("abort_reason")).alias("abort_code"),
        F.col("current_seq").alias("aborted_at_seq"),
    )
    return F.array(_event(F.lit(None), v.ABORT, payload))


def _emit(orders: DataFrame, events: Column) -> DataFrame:
    seq = F.col("_e.seq")
    return orders.withColumn("_e", F.explode(events)).select(
        s.stable_uuid(F.lit("event"), F.col("plan_id"), F.coalesce(seq, F.lit(0))).alias("event_id"),
        F.col("_e.kind").alias("event_type"),
        "plan_id",
        seq.alias("seq_id"),
        "order_id",
        _iso(F.col("created")).alias("timestamp"),
        F.lit(v.SCHEMA_VERSION).alias("schema_version"),
        F.col("_e.data").alias("data"),
        "user_id",
        "total_amount",
        "created",
    )


def plan_events(valid: DataFrame) -> DataFrame:
    """Five sequenced events per order, ``data`` as JSON text. No shuffle."""
    if "request_error" in valid.columns:
        valid = valid.filter(F.col("request_error").isNull())
    return _emit(valid, _five_events("items" in valid.columns))


def plan_abort_event(aborted: DataFrame) -> DataFrame:
    """One tombstone per refused order; it has no step number."""
    return _emit(aborted, _tombstone())


def plan_route(validated: DataFrame) -> DataFrame:
    """All events of all orders in one pass: five each, or the tombstone."""
    validated = validated.filter(F.col("request_error").isNull())
    refused = F.col("abort_reason").isNotNull()
    five = _five_events("items" in validated.columns)
    return _emit(validated, F.when(refused, _tombstone()).otherwise(five))


def envelope_json(events: DataFrame) -> Column:
    """The message text; a null step number is left out, as to_json drops nulls."""
    names = ["event_id", "event_type", "plan_id", "seq_id", "order_id", "timestamp"]
    return F.to_json(F.struct(*names, "schema_version", F.parse_json("data").alias("data")))


def as_log(events: DataFrame) -> DataFrame:
    """Planned events as a log in sending order; a tombstone is a plan's only event."""
    return events.select(
        "plan_id",
        "order_id",
        "seq_id",
        "event_id",
        "event_type",
        F.col("created").alias("ts"),
        F.coalesce("seq_id", F.lit(1)).cast("bigint").alias("pos"),
        F.col("event_id").alias("payload"),
        F.when(F.col("seq_id") == 1, F.col("user_id")).alias("user_id"),
        F.when(F.col("seq_id") == 1, F.col("total_amount")).alias("total_amount"),
    )
