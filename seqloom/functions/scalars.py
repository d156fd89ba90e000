"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v


def _lookup(table: dict, key: Column, default: str) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def status_of_event(event_type: Column) -> Column:
    """Order status an event type leads to; the empty string for unknown types."""
    return _lookup(v.STATUS_OF_EVENT, event_type, "")


def abort_code_of(reason: Column) -> Column:
    return _lookup(v.ABORT_CODE_OF_REASON, reason, v.DEFAULT_ABORT_CODE)


def uuid_shape(hex32: Column) -> Column:
    """Lay 32 hex digits out as 8-4-4-4-12."""
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, start, size) for start, size in cuts])


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped id that every retry of a task computes again unchanged."""
    return uuid_shape(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])))


def stable_hex(size: int, salt: str, *parts: Column) -> Column:
    joined = F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts])
    return F.substring(F.sha2(joined, 256), 1, size)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(v.UUID_PATTERN), F.lit(False))


def money(amount: Column) -> Column:
    """DECIMAL(10,2), null when the amount does not fit."""
    return amount.try_cast("decimal(10,2)")


def persist_error(
    event_type: Column, order_id: Column, amount: Column, seq: Column, plan_id: Column, user_id: Column
) -> Column:
    """Why the store would refuse the event, or null when it takes it.

    A tombstone only looks up its order, so nothing but its order id can be wrong.
    """
    sequenced = event_type != v.ABORT
    return (
        F.when(status_of_event(event_type) == "", F.lit("unknown event type"))
        .when(~is_uuid(order_id), F.lit("invalid order id"))
        .when(sequenced & amount.isNotNull() & money(amount).isNull(), F.lit("amount overflow"))
        .when(sequenced & (F.abs(seq) > v.MAX_STORED_STEP), F.lit("step overflow"))
        .when(sequenced & (F.length(plan_id) > v.MAX_PLAN_ID), F.lit("plan id too long"))
        .when(sequenced & (F.length(user_id) > v.MAX_USER_ID), F.lit("user id too long"))
    )


def traceparent(trace_id: Column, span_id: Column) -> Column:
    """W3C header from two hex ids, padded with zeros on the left."""
    return F.concat_ws(
        "-", F.lit("00"), F.lpad(trace_id, 32, "0"), F.lpad(span_id, 16, "0"), F.lit("01")
    )


def trace_id_of(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, v.TRACEPARENT_PATTERN, 1), F.lit(""))


def span_id_of(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, v.TRACEPARENT_PATTERN, 2), F.lit(""))


# --- fixed values: JSON kinds as the schema of a VARIANT names them ---
KINDS = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
    "null": ["VOID"],
}


def variant_kind(value: Column) -> Column:
    """Kind of a VARIANT value (see KINDS); SQL null where the field is absent."""
    schema = F.schema_of_variant(value)
    return F.substring_index(F.substring_index(schema, "<", 1), "(", 1)
