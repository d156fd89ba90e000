"""Contract checks of envelopes and payloads, one column of failed rules per contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.functions.scalars import KINDS, variant_kind

# --- fixed values: the contracts ---
# Rules of a field: its JSON kind, then optionally "optional", enum, minimum,
# format, min_items and the fields of array items.
ITEM = {
    "product_id": {"kind": "string"},
    "quantity": {"kind": "integer", "minimum": 1},
    "unit_price": {"kind": "number", "minimum": 0},
}
ITEM_STATUS = {
    "product_id": {"kind": "string"},
    "available": {"kind": "boolean"},
    "reserved_quantity": {"kind": "integer", "minimum": 0},
}
DECLARED = {
    "OrderCreated": {
        "user_id": {"kind": "string"},
        "items": {"kind": "array", "min_items": 1, "items": ITEM},
        "total_amount": {"kind": "number", "minimum": 0},
        "currency": {"kind": "string"},
    },
    "InventoryValidated": {
        "validated": {"kind": "boolean"},
        "items_status": {"kind": "array", "min_items": 1, "items": ITEM_STATUS},
    },
    "PaymentProcessed": {
        "payment_id": {"kind": "string", "format": "uuid"},
        "method": {"kind": "string", "enum": ["credit_card", "debit_card", "pix", "boleto"]},
        "status": {"kind": "string", "enum": ["approved", "rejected"]},
        "amount": {"kind": "number", "minimum": 0},
        "currency": {"kind": "string"},
    },
    "OrderShipped": {
        "tracking_code": {"kind": "string"},
        "carrier": {"kind": "string"},
        "estimated_delivery": {"kind": "string", "format": "date"},
    },
    "OrderCompleted": {
        "final_status": {"kind": "string", "enum": ["delivered", "cancelled"]},
        "completed_at": {"kind": "string", "format": "date-time"},
    },
    "ABORT_PLAN": {
        "reason": {"kind": "string"},
        "abort_code": {
            "kind": "string",
            "enum": ["inventory_failed", "payment_rejected", "timeout", "manual"],
        },
        "aborted_at_seq": {"kind": "integer", "minimum": 0, "optional": True},
    },
}
PRODUCER = {
    "OrderCreated": {
        "user_id": {"kind": "string"},
        "items": {"kind": "array", "min_items": 1, "items": ITEM},
        "total_amount": {"kind": "number", "minimum": 0},
        "currency": {"kind": "string", "optional": True},
    },
    "InventoryValidated": {
        "warehouse_id": {"kind": "string"},
        "all_items_available": {"kind": "boolean"},
        "reserved_until": {"kind": "string"},
    },
    "PaymentProcessed": {
        "payment_id": {"kind": "string"},
        "method": {"kind": "string"},
        "amount": {"kind": "number", "minimum": 0},
        "status": {"kind": "string"},
    },
    "OrderShipped": {
        "tracking_code": {"kind": "string"},
        "carrier": {"kind": "string"},
        "estimated_delivery": {"kind": "string"},
    },
    "OrderCompleted": {
        "completed_at": {"kind": "string"},
        "final_status": {"kind": "string", "optional": True},
    },
    "ABORT_PLAN": {
        "reason": {"kind": "string"},
        "abort_code": {"kind": "string"},
        "aborted_at_seq": {"kind": "integer", "minimum": 0, "optional": True},
    },
}
ENVELOPE = {
    "event_id": {"kind": "string", "format": "uuid"},
    "event_type": {"kind": "string", "enum": v.EVENT_TYPES},
    "plan_id": {"kind": "string", "format": "plan"},
    "seq_id": {"kind": "integer", "minimum": 1, "optional": True},
    "order_id": {"kind": "string", "format": "uuid"},
    "timestamp": {"kind": "string", "format": "date-time"},
    "data": {"kind": "object"},
}
CONTRACTS = {"declared": DECLARED, "producer": PRODUCER}
# The declared contract forbids further fields; the producer's models ignore them.
CLOSED = {"declared": True, "producer": False}


def _right_format(text: Column, name: str) -> Column:
    """Shape and, for dates, the calendar too."""
    if name == "date":
        return text.rlike(v.DATE_PATTERN) & text.try_cast("date").isNotNull()
    if name == "date-time":
        return text.rlike(v.DATE_TIME_PATTERN) & F.substring(text, 1, 19).try_cast("timestamp_ntz").isNotNull()
    return text.rlike({"uuid": v.UUID_PATTERN, "plan": v.PLAN_ID_PATTERN}[name])


def _fault(value: Column, name: str, rule: dict, closed: bool) -> Column:
    """Name of the check a field fails, else null. A field fails at most one."""
    get = lambda kind: F.try_variant_get(value, f"$.{name}", kind)
    kind = F.coalesce(variant_kind(get("variant")), F.lit("ABSENT"))
    checks = F.when(F.lit(False), "")
    if "enum" in rule:
        checks = checks.when(~get("string").isin(rule["enum"]), "enum")
    if "format" in rule:
        checks = checks.when(~_right_format(get("string"), rule["format"]), "format")
    if "minimum" in rule:
        checks = checks.when(get("double") < rule["minimum"], "minimum")
    if "items" in rule:
        members = get("array<variant>")
        checks = checks.when(F.size(members) < rule["min_items"], "minItems").when(
            F.exists(members, lambda m: _breaks(m, rule["items"], closed)), "items"
        )
    fault = F.when(kind.isin(KINDS[rule["kind"]]), checks).when(kind != "ABSENT", "type")
    if not rule.get("optional"):
        fault = fault.otherwise("required")
    return fault


def _extra_keys(value: Column, fields: dict) -> Column:
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0


def _breaks(member: Column, fields: dict, closed: bool) -> Column:
    """Does an array member break any of its rules?"""
    broken = variant_kind(member) != "OBJECT"
    for name, rule in fields.items():
        broken = broken | _fault(member, name, rule, closed).isNotNull()
    return broken | _extra_keys(member, fields) if closed else broken


def _failures(value: Column, fields: dict, closed: bool) -> Column:
    faults = [F.concat(F.lit(f"{name}:"), _fault(value, name, rule, closed)) for name, rule in fields.items()]
    if closed:
        faults.append(F.when(_extra_keys(value, fields), "additionalProperties"))
    return F.array_compact(F.array(*faults))


def validate_envelope(message: Column) -> Column:
    """Failed rules of an envelope (VARIANT). Only tombstones may lack a step number."""
    kind = F.try_variant_get(message, "$.event_type", "string")
    no_step = F.try_variant_get(message, "$.seq_id", "variant").isNull()
    sequenced = ~F.coalesce(kind == v.ABORT, F.lit(False))
    failures = _failures(message, ENVELOPE, closed=False)
    required = F.when(sequenced & no_step, F.lit("seq_id:required"))
    return F.array_compact(F.concat(failures, F.array(required)))


def validate_payload(event_type: Column, data: Column, contract: str) -> Column:
    """Failed rules of a payload (VARIANT) under one contract; null for unknown types."""
    out = F.lit(None).cast("array<string>")
    for name, fields in CONTRACTS[contract].items():
        out = F.when(event_type == name, _failures(data, fields, CLOSED[contract])).otherwise(out)
    return out


def validate_message(parsed: DataFrame, contract: str) -> Column:
    """Failed rules of every message (``parse_ok``, ``event_type``, ``data``), also of those with nothing to check."""
    known = F.coalesce(F.col("event_type").isin(*v.EVENT_TYPES), F.lit(False))
    one = lambda text: F.array(F.lit(text))
    return (
        F.when(~F.col("parse_ok"), one("message:unreadable"))
        .when(~known, one("event_type:enum"))
        .when(F.col("data").isNull(), one("data:required"))
        .otherwise(validate_payload(F.col("event_type"), F.col("data"), contract))
    )


def contract_report(parsed: DataFrame) -> DataFrame:
    """Messages and passes per event type and contract; unreadable messages have the type '-'."""
    each = [F.struct(F.lit(name).alias("contract"), validate_message(parsed, name).alias("failed")) for name in CONTRACTS]
    checked = parsed.select(F.coalesce("event_type", F.lit("-")).alias("event_type"), F.explode(F.array(*each)).alias("_c"))
    return checked.groupBy("event_type", F.col("_c.contract").alias("contract")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("_c.failed") == 0).alias("passed"),
    )
