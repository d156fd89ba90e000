"""Queries over messages: parsing, routing, contracts, dead letters, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v
from seqloom.operators import contracts, orders, pipeline, planner, reports, skew
from seqloom.plans import planning
from seqloom.plans.base import REPLAY, STATUS_SQL, uuid_sql
from seqloom.sources import messages, tables, wire


def _parsed(spark, sf):
    return wire.parse_envelope(messages.raw_events(spark, sf))


def _log(spark, sf):
    return wire.log_of(wire.typed_rows(_parsed(spark, sf)))


def _joined(column):
    return F.array_join(column, ",")


def src_headers(spark, sf):
    raw = messages.raw_events(spark, sf)
    header = wire.header_map(F.col("headers"))["traceparent"]
    return raw.select(wire.position().alias("pos"), header.alias("traceparent"))


def traceparent_parse(spark, sf):
    header = wire.header_map(F.col("headers"))["traceparent"]
    return messages.raw_events(spark, sf).select(
        wire.position().alias("pos"),
        s.trace_id_of(header).alias("trace_id"),
        s.span_id_of(header).alias("span_id"),
    )


def traceparent_format(spark, sf):
    """Short ids are padded with zeros."""
    return tables.read(spark, sf, "events").select(
        "event_id",
        s.traceparent(F.lower(F.hex("user_id")), F.lower(F.hex("event_id"))).alias("traceparent"),
    )


def parse_envelope(spark, sf):
    return _parsed(spark, sf).select(
        wire.position().alias("pos"),
        "parse_ok",
        F.coalesce("event_id", F.lit("-")).alias("event_id"),
        F.coalesce("event_type", F.lit("-")).alias("event_type"),
        F.coalesce("plan_id", F.lit("-")).alias("plan_id"),
        F.coalesce("seq_id", F.lit(0)).alias("seq_id"),
        F.coalesce("order_id", F.lit("-")).alias("order_id"),
    )


def status_of_event(spark, sf):
    log = _log(spark, sf)
    status = s.status_of_event(F.col("event_type")).alias("status")
    return log.groupBy("event_type", status).agg(F.count(F.lit(1)).alias("n"))


def payload_fields(spark, sf):
    return _log(spark, sf).select(
        "pos", F.coalesce("user_id", F.lit("unknown")).alias("user_id"), "total_amount"
    )


def money_cast(spark, sf):
    amount = F.col("l_extendedprice") * F.col("l_quantity") * 25
    return tables.read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        s.money(amount).cast("double").alias("money"),
        s.money(amount).isNull().alias("overflow"),
    )


def persist_check(spark, sf):
    log = orders.with_persist_error(_log(spark, sf))
    return log.select("pos", F.coalesce("persist_error", F.lit("none")).alias("persist_error"))


def validate_envelope(spark, sf):
    """A row per message; what is no JSON at all fails as such."""
    wire.last_key_wins(spark)
    raw = messages.raw_events(spark, sf)
    once = F.explode(F.array(F.struct(wire.whole_json(F.col("value")).alias("m")))).alias("_p")
    rows = raw.select(wire.position().alias("pos"), once)
    failed = F.when(F.col("_p.m").isNull(), F.array(F.lit("message:unreadable"))).otherwise(
        contracts.validate_envelope(F.col("_p.m"))
    )
    return rows.select("pos", _joined(failed).alias("failed"))


def _validated(spark, sf, contract):
    parsed = _parsed(spark, sf)
    failed = contracts.validate_message(parsed, contract)
    kind = F.coalesce("event_type", F.lit("-")).alias("event_type")
    return parsed.select(wire.position().alias("pos"), kind, _joined(failed).alias("failed"))


def validate_payload(spark, sf):
    return _validated(spark, sf, "declared")


def validate_producer_models(spark, sf):
    return _validated(spark, sf, "producer")


def contract_report(spark, sf):
    return contracts.contract_report(_parsed(spark, sf))


def _dead_letters(spark, sf):
    typed = skew.stage(wire.typed_rows(_parsed(spark, sf)))
    return wire.dead_letters(typed, pipeline.process_log(wire.log_of(typed)).gated)


def sink_dlq(spark, sf):
    letters = _dead_letters(spark, sf)
    return letters.filter(F.col("original_event").isNotNull()).select(
        "pos", "key", "error_code", "error_reason", "original_event_id"
    )


def sink_dlq_raw(spark, sf):
    letters = _dead_letters(spark, sf)
    return letters.filter(F.col("raw").isNotNull()).select("pos", "raw", "error_code", "error_reason")


def dead_letter_messages(spark, sf):
    return wire.dead_letter_records(_dead_letters(spark, sf))


def sink_event_log(spark, sf):
    events = planner.plan_route(planning.validated(spark, sf))
    return wire.to_records(events, planner.envelope_json(events))


def record_spans(spark, sf):
    """Every message of the raw log, the unreadable and stepless ones too, with what its arrival drained."""
    raw = messages.raw_events(spark, sf)
    header = wire.header_map(F.col("headers"))["traceparent"]
    ids = {"trace_id": s.trace_id_of(header), "parent_id": s.span_id_of(header)}
    parsed = wire.parse_envelope(raw.withColumns(ids))
    typed = skew.stage(wire.typed_rows(parsed, "trace_id", "parent_id"))
    missing = F.col("seq_id").isNull() & (F.col("event_type") != v.ABORT)
    reject = F.when(~F.col("parse_ok"), F.lit(v.PARSE_ERROR)).when(missing, F.lit(v.MISSING_SEQ_ID))
    gated = pipeline.process_log(wire.log_of(typed)).gated
    spans = reports.record_spans(typed.withColumn("reject", reject), gated)
    named = {c: F.coalesce(c, F.lit("-")) for c in ("event_type", "plan_id", "result")}
    return spans.withColumns(named)


QUERIES = {
    f.__name__: f
    for f in (
        src_headers,
        traceparent_parse,
        traceparent_format,
        parse_envelope,
        status_of_event,
        payload_fields,
        money_cast,
        persist_check,
        validate_envelope,
        validate_payload,
        validate_producer_models,
        contract_report,
        sink_dlq,
        sink_dlq_raw,
        dead_letter_messages,
        sink_event_log,
        record_spans,
    )
}

# The messages again, as JSON text, from the same table.
_RAW = f"""base as (select *, (json_extract_string(props, '$.k'))::integer k, value::decimal(12,2)::varchar amount,
    user_id || '_' || strftime(ts, '%Y%m%d') as owner, {uuid_sql("md5('ev' || event_id)")} as event_uuid,
    {uuid_sql("md5(user_id || '_' || strftime(ts, '%Y%m%d'))")} as order_uuid from events),
typed as (select *, case event_type when 'signup' then 'OrderCreated' when 'view' then 'InventoryValidated'
    when 'click' then 'PaymentProcessed' when 'purchase' then case when k < 50 then 'OrderShipped' else 'OrderCompleted' end
    else 'ABORT_PLAN' end as kind, '2024-01-06T10:00:00Z' as stamp from base),
body as (select *, case kind when 'OrderCreated' then 1 when 'InventoryValidated' then 2 when 'PaymentProcessed' then 3
    when 'OrderShipped' then 4 when 'OrderCompleted' then 5 end as step,
  case kind
    when 'OrderCreated' then '{{"user_id":' || case when k between 25 and 29 then '7' when k between 35 and 39 then '"user_' || repeat('x', 60) || '"' else '"user_' || user_id || '"' end
      || ',"items":' || case when k between 10 and 14 then '[]' else
           '[{{"product_id":"p' || k || '","quantity":' || k || ',"unit_price":' || amount || '}}]' end
      || ',"total_amount":' || case when k between 20 and 24 then '"' || amount || '"'
           when k between 30 and 34 then '123456789012.5' else amount end
      || ',"currency":"BRL"' || case when k between 15 and 19 then ',"note":"x"' else '' end || '}}'
    when 'InventoryValidated' then case when k < 50 then
        '{{"validated":true,"items_status":[{{"product_id":"p' || k || '","available":true,"reserved_quantity":' || k || '}}]}}'
      else '{{"warehouse_id":"wh_1","all_items_available":true,"reserved_until":"' || stamp || '"}}' end
    when 'PaymentProcessed' then case when k < 50 then '{{"payment_id":"' || event_uuid
        || '","method":"pix","status":"approved","amount":' || amount || ',"currency":"BRL"}}'
      else '{{"payment_id":"pay_1","method":"cash","status":"approved","amount":' || amount || '}}' end
    when 'OrderShipped' then '{{"tracking_code":"TRK1","carrier":"correios","estimated_delivery":"'
      || case when k < 20 then '2024-01-06' when k < 25 then '2024-13-06' else stamp end || '"}}'
    when 'OrderCompleted' then '{{"final_status":"' || case when k < 75 then 'delivered' else 'lost' end
      || '","completed_at":"' || stamp || '"}}'
    else case when k < 10 then '{{"reason":"r","abort_code":"timeout","aborted_at_seq":' || k || ',"total_amount":123456789012.5}}'
      when k < 50 then '{{"reason":"r","abort_code":"timeout","aborted_at_seq":' || k || '}}'
      else '{{"reason":"r","abort_code":"whatever"}}' end end as data_text from typed),
raw as (select (event_id // 4) * 4096 + event_id % 4 as pos, ts, order_uuid, owner, event_uuid, case when value < 1 then '{{not json' else
    '{{"event_id":"' || event_uuid || '","event_type":"' || case when value between 6 and 6.99 then 'Mystery' else kind end
    || '","plan_id":"' || case when value between 4 and 4.99 then 'bad plan ' else 'plan_' end || owner || '"'
    || case when step is null or value between 3 and 3.99 then '' when value between 1 and 1.99 then ',"seq_id":"' || step || '"'
         when value between 2 and 2.99 then ',"seq_id":1.5' when value between 9 and 9.99 then ',"seq_id":3000000000' else ',"seq_id":' || step end
    || ',"order_id":"' || case when value between 5 and 5.99 then 'no-uuid' else order_uuid end
    || '","timestamp":"' || case when value between 7 and 7.99 then 'yesterday' else stamp end
    || '","schema_version":"1.0"' || case when value between 8 and 8.99 then '' else ',"data":' || data_text end || '}}'
    || case when value between 11 and 11.19 then '] garbage' when value between 11.2 and 11.39 then ']'
         when value between 11.4 and 11.59 then '] ,[{{"a":1}}' when value between 11.6 and 11.79 then '],"'
         when value between 11.8 and 11.99 then ' {{"a":1}}' when value between 12 and 12.19 then ',"x"' else '' end
    end as value from body),
parsed as (select *, json_valid(value) and coalesce(json_type(case when json_valid(value) then value end, '$.seq_id'),
      'BIGINT') in ('BIGINT', 'UBIGINT') as parse_ok, case when json_valid(value) then value::json end as j from raw),
msg as (select pos, ts, json_extract_string(j, '$.event_id') as event_id, json_extract_string(j, '$.event_type') as event_type,
    json_extract_string(j, '$.plan_id') as plan_id, json_extract_string(j, '$.seq_id')::bigint as seq_id,
    json_extract_string(j, '$.order_id') as order_id, json_extract(j, '$.data') as data from parsed where parse_ok),
ev as (select *, event_id as payload, case when json_type(data, '$.user_id') = 'VARCHAR'
      then json_extract_string(data, '$.user_id') end as user_id,
    case when json_type(data, '$.total_amount') in ('BIGINT', 'UBIGINT', 'DOUBLE')
      then json_extract_string(data, '$.total_amount')::double end as total_amount from msg)"""

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_ERROR = f"""case when ({STATUS_SQL}) = '' then 'unknown event type'
  when not regexp_matches(order_id, '{_UUID}') then 'invalid order id'
  when event_type = 'ABORT_PLAN' then null
  when total_amount is not null and try_cast(total_amount as decimal(10,2)) is null then 'amount overflow'
  when seq_id > 2147483647 or seq_id < -2147483647 then 'step overflow'
  when length(plan_id) > 100 then 'plan id too long' when length(user_id) > 50 then 'user id too long' end"""
# Refused events of this log, instead of the unknown types of the others.
_REPLAY = REPLAY.replace("event_type like 'Unknown%' as bad", f"({_ERROR}) is not null as bad")

# --- the contracts once more, written out for SQL: field, JSON types, then checks on its text ---
_TEXT, _INT, _NUM, _BOOL, _ARR, _OBJ = (
    "'VARCHAR'", "'BIGINT', 'UBIGINT'", "'BIGINT', 'UBIGINT', 'DOUBLE'", "'BOOLEAN'", "'ARRAY'", "'OBJECT'",
)
_IS_UUID = f"regexp_matches(@text, '{_UUID}')"
_IS_DATE = "regexp_matches(@text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and try_cast(@text as date) is not null"
_IS_TIME = (
    "regexp_matches(@text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$')"
    " and try_cast(substr(@text, 1, 19) as timestamp) is not null"
)


def _field(doc, name, types, must=True, **checks):
    """case expression: the rule that a field breaks, or null. A check is SQL on @text (or @array) that must hold."""
    kind, text = f"json_type({doc}, '$.{name}')", f"json_extract_string({doc}, '$.{name}')"
    whens = [f"when {kind} is null then {'null' if not must else repr(name + ':required')}"]
    whens.append(f"when {kind} not in ({types}) then '{name}:type'")
    for label, check in checks.items():
        sql = check.replace("@text", text).replace("@array", f"json_extract({doc}, '$.{name}[*]')")
        whens.append(f"when not ({sql}) then '{name}:{label}'")
    return f"case {' '.join(whens)} end"


def _no_more(doc, *names):
    listed = ", ".join(f"'{n}'" for n in names)
    return f"case when len(list_filter(json_keys({doc}), lambda key: key not in ({listed}))) > 0 then 'additionalProperties' end"


def _all_rules(*parts):
    return f"concat_ws(',', {', '.join(parts)})"


def _member(*fields):
    good = " and ".join(f"({f}) is null" for f in fields)
    return f"len(list_filter(@array, lambda m: not coalesce({good}, false))) = 0"


_PLUS = "@text::double >= 0"
_LINE = [_field("m", "product_id", _TEXT), _field("m", "quantity", _INT, minimum="@text::double >= 1"), _field("m", "unit_price", _NUM, minimum=_PLUS)]
_STOCK = [_field("m", "product_id", _TEXT), _field("m", "available", _BOOL), _field("m", "reserved_quantity", _INT, minimum=_PLUS)]
_D = "data"
_DECLARED = f"""case event_type
  when 'OrderCreated' then {_all_rules(
    _field(_D, "user_id", _TEXT),
    _field(_D, "items", _ARR, minItems="len(@array) >= 1", items=_member(*_LINE, _no_more("m", "product_id", "quantity", "unit_price"))),
    _field(_D, "total_amount", _NUM, minimum=_PLUS), _field(_D, "currency", _TEXT),
    _no_more(_D, "user_id", "items", "total_amount", "currency"))}
  when 'InventoryValidated' then {_all_rules(
    _field(_D, "validated", _BOOL),
    _field(_D, "items_status", _ARR, minItems="len(@array) >= 1", items=_member(*_STOCK, _no_more("m", "product_id", "available", "reserved_quantity"))),
    _no_more(_D, "validated", "items_status"))}
  when 'PaymentProcessed' then {_all_rules(
    _field(_D, "payment_id", _TEXT, format=_IS_UUID),
    _field(_D, "method", _TEXT, enum="@text in ('credit_card', 'debit_card', 'pix', 'boleto')"),
    _field(_D, "status", _TEXT, enum="@text in ('approved', 'rejected')"),
    _field(_D, "amount", _NUM, minimum=_PLUS), _field(_D, "currency", _TEXT),
    _no_more(_D, "payment_id", "method", "status", "amount", "currency"))}
  when 'OrderShipped' then {_all_rules(
    _field(_D, "tracking_code", _TEXT), _field(_D, "carrier", _TEXT), _field(_D, "estimated_delivery", _TEXT, format=_IS_DATE),
    _no_more(_D, "tracking_code", "carrier", "estimated_delivery"))}
  when 'OrderCompleted' then {_all_rules(
    _field(_D, "final_status", _TEXT, enum="@text in ('delivered', 'cancelled')"), _field(_D, "completed_at", _TEXT, format=_IS_TIME),
    _no_more(_D, "final_status", "completed_at"))}
  when 'ABORT_PLAN' then {_all_rules(
    _field(_D, "reason", _TEXT),
    _field(_D, "abort_code", _TEXT, enum="@text in ('inventory_failed', 'payment_rejected', 'timeout', 'manual')"),
    _field(_D, "aborted_at_seq", _INT, must=False, minimum=_PLUS),
    _no_more(_D, "reason", "abort_code", "aborted_at_seq"))} end"""
_PRODUCER = f"""case event_type
  when 'OrderCreated' then {_all_rules(
    _field(_D, "user_id", _TEXT), _field(_D, "items", _ARR, minItems="len(@array) >= 1", items=_member(*_LINE)),
    _field(_D, "total_amount", _NUM, minimum=_PLUS), _field(_D, "currency", _TEXT, must=False))}
  when 'InventoryValidated' then {_all_rules(
    _field(_D, "warehouse_id", _TEXT), _field(_D, "all_items_available", _BOOL), _field(_D, "reserved_until", _TEXT))}
  when 'PaymentProcessed' then {_all_rules(
    _field(_D, "payment_id", _TEXT), _field(_D, "method", _TEXT), _field(_D, "amount", _NUM, minimum=_PLUS), _field(_D, "status", _TEXT))}
  when 'OrderShipped' then {_all_rules(
    _field(_D, "tracking_code", _TEXT), _field(_D, "carrier", _TEXT), _field(_D, "estimated_delivery", _TEXT))}
  when 'OrderCompleted' then {_all_rules(_field(_D, "completed_at", _TEXT), _field(_D, "final_status", _TEXT, must=False))}
  when 'ABORT_PLAN' then {_all_rules(
    _field(_D, "reason", _TEXT), _field(_D, "abort_code", _TEXT), _field(_D, "aborted_at_seq", _INT, must=False, minimum=_PLUS))} end"""
_ENVELOPE = _all_rules(
    _field("j", "event_id", _TEXT, format=_IS_UUID),
    _field("j", "event_type", _TEXT, enum="""@text in ('OrderCreated', 'InventoryValidated', 'PaymentProcessed', 'OrderShipped',
      'OrderCompleted', 'ABORT_PLAN')"""),
    _field("j", "plan_id", _TEXT, format="regexp_matches(@text, '^plan_[a-zA-Z0-9_-]+$')"),
    _field("j", "seq_id", _INT, must=False, minimum="@text::double >= 1"),
    _field("j", "order_id", _TEXT, format=_IS_UUID),
    _field("j", "timestamp", _TEXT, format=_IS_TIME),
    _field("j", "data", _OBJ),
    """case when coalesce(json_extract_string(j, '$.event_type') <> 'ABORT_PLAN', true)
      and json_type(j, '$.seq_id') is null then 'seq_id:required' end""",
)


def _message_sql(rules: str) -> str:
    """A row per message, with those that there is nothing to check in."""
    return f"""select parsed.pos, coalesce(event_type, '-') as event_type,
        case when not parse_ok then 'message:unreadable'
          when event_type not in ('OrderCreated', 'InventoryValidated', 'PaymentProcessed', 'OrderShipped', 'OrderCompleted',
            'ABORT_PLAN') then 'event_type:enum'
          when data is null then 'data:required' else {rules} end as failed
        from parsed left join msg on msg.pos = parsed.pos"""


_W = f"with {_RAW}\n"
_DLQ = f"""with recursive {_RAW},\n{_REPLAY},
bad as (select pos, order_id as key, 'MISSING_SEQ_ID' as error_code, 'missing seq_id for non-ABORT event' as error_reason,
    event_id as original_event_id from ev where seq_id is null and event_type <> 'ABORT_PLAN'
  union all
  select pos, order_id, 'DB_ERROR', 'db process error: ' || ({_ERROR}), event_id
  from (select e.* from applied a join ev e on e.plan_id = a.plan_id and e.pos = a.taken) where ({_ERROR}) is not null)
select * from bad"""

ORACLES = {
    "record_spans": f"""with recursive {_RAW},\n{_REPLAY},
        rec as (select parsed.pos, parsed.ts, md5(parsed.owner) as trace_id, substr(md5(parsed.event_uuid), 1, 16) as parent_id,
          substr(md5('record|' || parsed.pos), 1, 16) as span_id, parsed.parse_ok, msg.event_type, msg.plan_id, msg.seq_id
          from parsed left join msg on msg.pos = parsed.pos),
        known as (select rec.*, case when not parse_ok then 'PARSE_ERROR'
            when seq_id is null and event_type <> 'ABORT_PLAN' then 'MISSING_SEQ_ID' end as reject, run.verdict
          from rec left join run on run.pos = rec.pos)
        select 'process-event' as operation, pos, ts, trace_id, span_id, parent_id, coalesce(event_type, '-') as event_type,
          coalesce(plan_id, '-') as plan_id, coalesce(reject, verdict, '-') as result,
          case when reject is not null or event_type = 'ABORT_PLAN' then 'error' else 'ok' end as status from known
        union all
        select 'drain-event', pos, at_ts, trace_id, substr(md5('drain|' || pos), 1, 16), moved_by, event_type, plan_id, '-',
          case when ({_ERROR}) is not null then 'error' else 'ok' end
        from (select e.*, a.applied_pos from applied a join ev e on e.plan_id = a.plan_id and e.pos = a.taken where a.taken <> a.applied_pos) d
        join (select pos as at_pos, ts as at_ts, trace_id, span_id as moved_by from known) k on k.at_pos = d.applied_pos""",
    "src_headers": _W
    + """select pos, '00-' || md5(owner) || '-' || substr(md5(event_uuid), 1, 16) || '-01' as traceparent
        from raw""",
    "traceparent_parse": _W + "select pos, md5(owner) as trace_id, substr(md5(event_uuid), 1, 16) as span_id from raw",
    "traceparent_format": """select event_id, '00-' || lpad(printf('%x', user_id), 32, '0') || '-'
        || lpad(printf('%x', event_id), 16, '0') || '-01' as traceparent from events""",
    "parse_envelope": _W
    + """select parsed.pos, parse_ok, coalesce(event_id, '-') as event_id, coalesce(event_type, '-') as event_type,
        coalesce(plan_id, '-') as plan_id, coalesce(seq_id, 0) as seq_id, coalesce(order_id, '-') as order_id
        from parsed left join msg on msg.pos = parsed.pos""",
    "status_of_event": _W + f"select event_type, {STATUS_SQL} as status, count(*) as n from ev group by all",
    "payload_fields": _W + "select pos, coalesce(user_id, 'unknown') as user_id, total_amount from ev",
    "money_cast": """select l_orderkey, l_linenumber, l_partkey,
        try_cast(l_extendedprice * l_quantity * 25 as decimal(10,2))::double as money,
        try_cast(l_extendedprice * l_quantity * 25 as decimal(10,2)) is null as overflow from lineitem""",
    "persist_check": _W + f"select pos, coalesce({_ERROR}, 'none') as persist_error from ev",
    "validate_envelope": _W
    + f"select pos, case when j is null then 'message:unreadable' else {_ENVELOPE} end as failed from parsed",
    "validate_payload": _W + _message_sql(_DECLARED),
    "validate_producer_models": _W + _message_sql(_PRODUCER),
    "contract_report": _W
    + f"""select event_type, contract, count(*) as n, count(*) filter (failed = '') as passed from (
        select *, 'declared' as contract from ({_message_sql(_DECLARED)})
        union all select *, 'producer' from ({_message_sql(_PRODUCER)})) group by all""",
    "sink_dlq": _DLQ,
    "sink_dlq_raw": _W
    + """select pos, value as raw, 'PARSE_ERROR' as error_code, 'failed to parse event JSON' as error_reason
        from parsed where not parse_ok""",
}
