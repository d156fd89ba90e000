"""SQL pieces for the oracles: the derived logs, written independently."""

from __future__ import annotations


def uuid_sql(hex32: str) -> str:
    parts = [f"substr({hex32}, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return "(" + " || '-' || ".join(parts) + ")"


STATUS_SQL = """case event_type
  when 'OrderCreated' then 'pending' when 'InventoryValidated' then 'inventory_validated'
  when 'PaymentProcessed' then 'payment_processed' when 'OrderShipped' then 'shipped'
  when 'OrderCompleted' then 'completed' when 'ABORT_PLAN' then 'aborted' else '' end"""

TYPE_SQL = """case {seq} when 1 then 'OrderCreated' when 2 then 'InventoryValidated'
  when 3 then 'PaymentProcessed' when 4 then 'OrderShipped' when 5 then 'OrderCompleted'
  else 'Unknown' || {seq} end"""

_LINE_ID = "md5(concat_ws('|', 'line', l_orderkey, l_shipdate::date, l_partkey, l_linenumber))"


def lineitem_log(plan: str = "'plan_' || l_orderkey") -> str:
    return f"""ev as (
  select {plan} as plan_id, {uuid_sql("md5(l_orderkey::varchar)")} as order_id,
    l_linenumber as seq_id, {uuid_sql(_LINE_ID)} as event_id,
    {TYPE_SQL.format(seq="l_linenumber")} as event_type, l_shipdate as ts,
    date_diff('day', date '1970-01-01', l_shipdate::date)::bigint * 281474976710656
      + l_partkey * 8 + l_linenumber as pos,
    {uuid_sql(_LINE_ID)} as payload,
    case when l_returnflag = 'A' then 'supplier_' || l_suppkey end as user_id,
    case when l_discount >= 0.05 then l_extendedprice end as total_amount
  from lineitem)"""


LINEITEM = lineitem_log()
SPLIT = lineitem_log("'plan_' || l_orderkey || '_' || l_returnflag")

EVENTS = f"""ev as (
  select 'plan_' || user_id || '_' || strftime(ts, '%Y%m%d') as plan_id,
    {uuid_sql("md5(user_id || '_' || strftime(ts, '%Y%m%d'))")} as order_id,
    st as seq_id, {uuid_sql("md5('ev' || event_id)")} as event_id,
    case when event_type = 'error' then 'ABORT_PLAN' else {TYPE_SQL.format(seq="st")} end as event_type,
    ts, event_id as pos, {uuid_sql("md5('ev' || event_id)")} as payload,
    case when event_type = 'signup' then 'user_' || user_id end as user_id,
    case when event_type in ('signup', 'click') then value end as total_amount
  from (select *, case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 3
          when 'purchase' then 4 end::integer as st from events))"""

SESSIONS = f"""ev as (
  select 'plan_user_' || user_id as plan_id, {uuid_sql("md5('session' || user_id)")} as order_id,
    case when not tomb then st end as seq_id, {uuid_sql("md5('session' || event_id)")} as event_id,
    case when tomb then 'ABORT_PLAN' else {TYPE_SQL.format(seq="st")} end as event_type,
    ts, event_id as pos, {uuid_sql("md5('session' || event_id)")} as payload
  from (select *, (1 + day(ts) // 6 + k % 3)::integer as st, event_type = 'error' and k < 25 as tomb
        from (select *, (json_extract_string(props, '$.k'))::integer as k from events)))"""

# Closed form, by joins: verdicts of sequenced rows; reach r, first arrival a.
GATE = """ab as (select plan_id, min(pos) b from ev where event_type = 'ABORT_PLAN' group by all),
x as (select ev.*, ab.b from ev left join ab using (plan_id)
      where event_type <> 'ABORT_PLAN' and seq_id is not null),
fst as (select plan_id, seq_id, min(pos) a from x where (b is null or pos < b) and seq_id >= 1 group by all),
rd as (select plan_id, seq_id, a, case when row_number() over w = seq_id then max(a) over w end r
       from fst window w as (partition by plan_id order by seq_id)),
g as (select x.*, rs.r as applied_pos,
    case when b is not null and x.pos > b then 'ABORTED'
         when x.seq_id <= 0 or rs.r < x.pos then 'DUPLICATE'
         when x.seq_id = 1 or rp.r < x.pos then 'OK' else 'OUT_OF_ORDER' end as verdict
  from x left join rd rs on rs.plan_id = x.plan_id and rs.seq_id = x.seq_id
         left join rd rp on rp.plan_id = x.plan_id and rp.seq_id = x.seq_id - 1)"""

# What reaches the store: the arrival itself, or the smallest waiting payload.
APPLIED = GATE + """,
ap as (select * from g where applied_pos is not null and pos <= applied_pos
       qualify row_number() over (partition by plan_id, seq_id order by payload, pos) = 1)"""

# Waiting members: one per (plan, step, payload).
WAITING = APPLIED + """,
wait as (select plan_id, seq_id, payload, min(pos) pos, max(ts) last_ts, max(applied_pos) applied_pos, max(b) b
         from g where verdict = 'OUT_OF_ORDER' group by all),
still as (select * from wait where b is null
          and not exists (select 1 from ap where ap.plan_id = wait.plan_id
                          and ap.seq_id = wait.seq_id and ap.payload = wait.payload))"""

# Event-by-event run of every plan, with refused events (unknown types) that skip the drain.
REPLAY = """arr as (select *, row_number() over (partition by plan_id order by pos) n,
    event_type = 'ABORT_PLAN' as tomb, event_type like 'Unknown%' as bad from ev
    where event_type = 'ABORT_PLAN' or seq_id is not null),
run as (
  select plan_id, 0::bigint n, 0::bigint c, false dead, []::struct(s bigint, payload varchar, pos bigint)[] w,
    null::varchar verdict, null::bigint pos, []::struct(s bigint, payload varchar, pos bigint)[] took
  from (select distinct plan_id from arr)
  union all
  select plan_id, n, case when v = 'OK' then lst else c end, dead or tomb,
    case when tomb then [] when v = 'OUT_OF_ORDER' then
           case when list_contains(list_transform(w, lambda m: m.s || ':' || m.payload), seq_id || ':' || payload)
                then w else list_append(w, me) end
         else list_filter(w, lambda m: not list_contains(list_transform(drained, lambda d: d.pos), m.pos)) end,
    v, pos, case when v = 'OK' then list_prepend(me, drained) else [] end
  from (select *, case when v = 'OK' and not bad then
            list_filter(w, lambda m: m.s > seq_id and m.s <= lst and m.payload =
              list_min(list_transform(list_filter(w, lambda u: u.s = m.s), lambda u: u.payload))) else [] end drained
    from (select *, case when v = 'OK' and not bad then list_min(list_filter(range(seq_id + 1, seq_id + len(w) + 2),
              lambda k: not list_contains(list_transform(w, lambda m: m.s), k))) - 1 else seq_id end::bigint lst
      from (select run.plan_id, arr.n, run.c, run.dead, run.w, arr.tomb, arr.bad, arr.seq_id, arr.payload, arr.pos,
              {s: arr.seq_id, payload: arr.payload, pos: arr.pos}::struct(s bigint, payload varchar, pos bigint) me,
              case when arr.tomb then null when run.dead then 'ABORTED' when arr.seq_id <= run.c then 'DUPLICATE'
                   when arr.seq_id = run.c + 1 then 'OK' else 'OUT_OF_ORDER' end v
            from run join arr on arr.plan_id = run.plan_id and arr.n = run.n + 1)))),
applied as (select plan_id, pos as applied_pos, unnest(took, recursive := true) from
            (select plan_id, pos, list_transform(took, lambda m: {taken: m.pos}) took from run where len(took) > 0))"""

# The same run under the clock: what waits is dropped an hour after the last addition, tombstones lapse after a day.
CLOCKED = """arr as (select *, row_number() over (partition by plan_id order by pos) n,
    event_type = 'ABORT_PLAN' as tomb, event_type like 'Unknown%' as bad from ev
    where event_type = 'ABORT_PLAN' or seq_id is not null),
run as (
  select plan_id, 0::bigint n, 0::bigint c, null::timestamp until, null::timestamp last_add,
    []::struct(s bigint, payload varchar, pos bigint)[] w, null::varchar verdict, null::bigint pos,
    []::struct(s bigint, payload varchar, pos bigint)[] took, []::struct(s bigint, payload varchar, pos bigint)[] lost
  from (select distinct plan_id from arr)
  union all
  select plan_id, n, case when v = 'OK' then lst else c end, case when tomb then ts + interval 1 day else until end,
    case when tomb then null when v = 'OUT_OF_ORDER' then coalesce(greatest(last_add, ts), ts) else last_add end,
    case when tomb then [] when v = 'OUT_OF_ORDER' then
           case when list_contains(list_transform(w, lambda m: m.s || ':' || m.payload), seq_id || ':' || payload)
                then w else list_append(w, me) end
         else list_filter(w, lambda m: not list_contains(list_transform(drained, lambda d: d.pos), m.pos)) end,
    v, pos, case when v = 'OK' then list_prepend(me, drained) else [] end, lost
  from (select *, case when v = 'OK' and not bad then
            list_filter(w, lambda m: m.s > seq_id and m.s <= lst and m.payload =
              list_min(list_transform(list_filter(w, lambda u: u.s = m.s), lambda u: u.payload))) else [] end drained
    from (select *, case when v = 'OK' and not bad then list_min(list_filter(range(seq_id + 1, seq_id + len(w) + 2),
              lambda k: not list_contains(list_transform(w, lambda m: m.s), k))) - 1 else seq_id end::bigint lst
      from (select *, case when late then [] else was end as w, case when late then was else [] end as lost,
              case when late then null else had end as last_add,
              {s: seq_id, payload: payload, pos: pos}::struct(s bigint, payload varchar, pos bigint) me,
              case when tomb then null when ts < until then 'ABORTED' when seq_id <= c then 'DUPLICATE'
                   when seq_id = c + 1 then 'OK' else 'OUT_OF_ORDER' end v
            from (select run.plan_id, arr.n, run.c, run.until, run.w as was, run.last_add as had, arr.tomb, arr.bad, arr.seq_id,
                    arr.payload, arr.pos, arr.ts, coalesce(arr.ts >= run.last_add + interval 1 hour, false) as late
                  from run join arr on arr.plan_id = run.plan_id and arr.n = run.n + 1))))),
clock as (select max(ts) - interval 10 minute as stands from ev),
last_run as (select * from run qualify row_number() over (partition by plan_id order by n desc) = 1),
timed_out as (select plan_id, unnest(lost, recursive := true) from (
    select plan_id, list_transform(lost, lambda m: {gone: m.pos}) as lost from run where len(lost) > 0
    union all
    select plan_id, list_transform(w, lambda m: {gone: m.pos}) from last_run, clock where len(w) > 0 and last_add + interval 1 hour <= stands)),
applied as (select plan_id, pos as applied_pos, unnest(took, recursive := true) from
            (select plan_id, pos, list_transform(took, lambda m: {taken: m.pos}) took from run where len(took) > 0))"""

# Store timeline: good applied events and tombstones, then the order guard by self-join.
STORE = REPLAY + f""",
tl as (select e.order_id, e.plan_id, e.event_id, e.event_type, e.payload, e.pos, false is_abort, e.seq_id,
         a.applied_pos as at_pos, t.ts as at_ts, {STATUS_SQL.replace('event_type', 'e.event_type', 1)} as status,
         coalesce(e.user_id, 'unknown') user_id, e.total_amount::decimal(10,2) total_amount
       from applied a join ev e on e.plan_id = a.plan_id and e.pos = a.taken
       join ev t on t.plan_id = a.plan_id and t.pos = a.applied_pos
       where e.event_type not like 'Unknown%'
       union all
       select order_id, plan_id, event_id, event_type, payload, pos, true, 0, pos, ts, 'aborted',
         'unknown', null from ev where event_type = 'ABORT_PLAN'),
acc as (select * from tl where not is_abort and not exists (select 1 from tl p where p.order_id = tl.order_id
        and not p.is_abort and p.seq_id >= tl.seq_id and (p.at_pos, p.seq_id) < (tl.at_pos, tl.seq_id))),
abt as (select *, exists (select 1 from acc where acc.order_id = t.order_id and acc.at_pos < t.at_pos) effective,
          coalesce((select max(acc.at_pos) from acc where acc.order_id = t.order_id and acc.at_pos < t.at_pos) >
            coalesce((select max(o.at_pos) from tl o where o.order_id = t.order_id and o.is_abort and o.at_pos < t.at_pos), -1),
            false) changes_status
        from tl t where is_abort),
ord as (select acc.order_id as id, arg_min(user_id, seq_id) user_id,
          case when max(z.late) is not null then 'aborted' else arg_max(status, seq_id) end status,
          arg_max(total_amount, seq_id) filter (total_amount is not null) total_amount,
          arg_max(plan_id, seq_id) plan_id, max(seq_id) last_seq_processed, min(at_ts) created_at,
          coalesce(max(z.late), max(at_ts)) updated_at
        from acc left join (select abt.order_id, min(abt.at_ts) late from abt
             join (select order_id, max(at_pos) m from acc group by all) l on l.order_id = abt.order_id and abt.at_pos > l.m
             group by all) z on z.order_id = acc.order_id
        group by acc.order_id),
obx as (select {uuid_sql("md5(concat_ws('|', 'outbox', plan_id, event_id, pos))")} as id, order_id as aggregate_id,
          event_type, payload, 'order-notifications' as topic, false as processed, at_ts as created_at
        from (select * from acc union all by name select * exclude (effective, changes_status) from abt))"""


def q(log: str, stage: str, select: str) -> str:
    recursive = "recursive " if "run as (" in stage else ""
    return f"with {recursive}{log},\n{stage}\n{select}" if stage else f"with {log}\n{select}"


# Order requests after defaults and rules; ``limit`` is the largest total allowed.
def planned(limit: int) -> str:
    return f"""req as (
  select o_orderkey k, o_orderdate created, o_totalprice tp,
    case when o_orderkey % 97 = 0 then 'unreadable' when o_orderkey % 89 = 0 then 'no_total' end as request_error,
    case when o_orderstatus = 'F' or o_orderkey % 97 = 0 then {uuid_sql("md5('order|' || o_orderkey)")}
         else {uuid_sql("md5(o_orderkey::varchar)")} end as order_id,
    'plan_' || substr(sha256('plan|' || o_orderkey), 1, 16) as plan_id,
    'customer_' || o_custkey as user_id,
    case when o_orderpriority = '2-HIGH' or o_orderkey % 97 = 0 then 'BRL' else 'USD' end as currency,
    case o_orderpriority when '5-LOW' then 0 when '4-NOT SPECIFIED' then 1 else 2 end as n_items,
    case o_orderpriority when '5-LOW' then 0 when '4-NOT SPECIFIED' then o_totalprice
      else (o_totalprice - 100.0::double) + 100.0::double end as calculated,
    case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 0.0::double
         when o_orderstatus = 'P' then o_totalprice + 0.02::double else o_totalprice end as total_amount
  from orders),
val as (select *, case when request_error is not null then null when n_items = 0 then 'items_empty' when total_amount <= 0 then 'invalid_amount'
    when total_amount > {limit} then 'amount_exceeds_limit'
    when abs(calculated - total_amount) > 0.01::double then 'amount_mismatch' end as abort_reason from req),
steps as (select unnest([1, 2, 3, 4, 5]) as s),
pe as (
  select plan_id, order_id, s::integer as seq_id, {uuid_sql("md5(concat_ws('|', 'event', plan_id, s))")} as event_id,
    {TYPE_SQL.format(seq="s")} as event_type, created as ts, s::bigint as pos,
    case when s = 1 then user_id end as user_id, case when s = 1 then total_amount end as total_amount
  from val join steps on abort_reason is null and request_error is null
  union all
  select plan_id, order_id, null, {uuid_sql("md5(concat_ws('|', 'event', plan_id, 0))")}, 'ABORT_PLAN',
    created, 1, null, null from val where abort_reason is not null)"""


PLAN_LIMIT = 400_000
PLANNED = planned(PLAN_LIMIT) + ",\nev as (select *, event_id as payload from pe)"
EVENTS_TWICE = EVENTS.replace("ev as (", "once as (", 1) + """,
ev as (select * from once union all select * replace (pos + 1000000000000 as pos) from once)"""
