"""Queries over outbox delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators import delivery, pipeline
from seqloom.plans.base import EVENTS, STORE, q, uuid_sql
from seqloom.sources import tables


def delivery_outcome(spark, sf):
    outcomes = delivery.delivery_outcome(tables.delivery_attempts(spark, sf))
    return outcomes.groupBy("endpoint", "outcome", "breaker_failure").agg(
        F.count(F.lit(1)).alias("n")
    )


def retry_schedule(spark, sf):
    return delivery.retry_schedule(pipeline.process_log(tables.log_events(spark, sf)).outbox)


def failure_streaks(spark, sf):
    return delivery.failure_streaks(
        tables.delivery_attempts(spark, sf), v.BREAKER_DEFAULTS["failure_threshold"]
    )


def breaker_replay(spark, sf):
    """Slow attempts: the breaker stays open for an hour here."""
    replayed = delivery.breaker_replay(tables.delivery_attempts(spark, sf), open_seconds=3600)
    return replayed.select("endpoint", "attempt_id", "called", "breaker_state")


def breaker_replay_settings(spark, sf):
    """The settings change while the attempts run."""
    attempts, changes = tables.delivery_attempts(spark, sf), tables.breaker_settings(spark, sf)
    replayed = delivery.breaker_replay(attempts, changes=changes)
    return replayed.select("endpoint", "attempt_id", "called", "breaker_state")


def retry_history(spark, sf):
    """Attempts of outbox rows as they were made, through a breaker that stays open for an hour."""
    attempts = delivery.breaker_replay(tables.order_attempts(spark, sf), open_seconds=3600).drop("breaker_failure", "outcome")
    outbox = pipeline.process_log(tables.log_events(spark, sf)).outbox
    return delivery.retry_history(delivery.matched_attempts(outbox, attempts))


def effective_config(spark, sf):
    return delivery.effective_config(tables.config_changes(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        delivery_outcome,
        retry_schedule,
        retry_history,
        failure_streaks,
        breaker_replay,
        breaker_replay_settings,
        effective_config,
    )
}

_ATTEMPTS = """att as (select 'hook_' || substr(md5(user_id::varchar), 1, 1) as endpoint, event_id as attempt_id, ts,
    value > 150 as lost, case event_type when 'signup' then 200 when 'view' then 204 when 'click' then 503
      when 'purchase' then 404 else 500 end as code from events),
o as (select *, lost or code >= 500 as bad from att)"""
_REPLAY = f"""with recursive {_ATTEMPTS},
arr as (select *, row_number() over (partition by endpoint order by ts, attempt_id) n from o),
run as (
  select endpoint, 0::bigint n, 'closed' st, 0 c, null::timestamp until, null::bigint attempt_id, false called
  from (select distinct endpoint from arr)
  union all
  select endpoint, n,
    case when s1 = 'open' then 'open' when s1 = 'half-open' and bad then 'open'
         when s1 = 'half-open' and c1 + 1 >= 2 then 'closed' when s1 = 'closed' and bad and c1 + 1 >= 5 then 'open'
         else s1 end,
    case when s1 = 'open' then 0 when s1 = 'half-open' and (bad or c1 + 1 >= 2) then 0
         when s1 = 'half-open' then c1 + 1 when bad and c1 + 1 < 5 then c1 + 1 else 0 end,
    case when s1 = 'open' then until when bad and (s1 = 'half-open' or c1 + 1 >= 5) then ts + interval 3600 second end,
    attempt_id, s1 <> 'open'
  from (select run.endpoint, arr.n, arr.ts, arr.bad, arr.attempt_id, until,
          case when st = 'open' and arr.ts > until then 'half-open' else st end s1,
          case when st = 'open' then 0 else c end c1
        from run join arr on arr.endpoint = run.endpoint and arr.n = run.n + 1))"""

# The same with the settings in force at each attempt, by one order of changes and attempts.
_SETTINGS = f"""with recursive {_ATTEMPTS},
chg as (select event_id as id, ts, event_type, (json_extract_string(props, '$.k'))::integer as k from events where value < 2.5),
line as (
  select ts, 0 as kind, id, case when event_type = 'signup' then 1 + k % 4 end as f, case when event_type = 'view' then 1 + k % 3 end as p,
    case when event_type = 'purchase' then 600 + 300 * (k % 7) end as d, null::varchar as endpoint, false as bad from chg
  union all
  select ts, 1, attempt_id, null, null, null, endpoint, bad from o),
inforce as (select *, coalesce(last_value(f ignore nulls) over w, 5) as ff, coalesce(last_value(p ignore nulls) over w, 2) as pp,
    coalesce(last_value(d ignore nulls) over w, 30) as dd from line window w as (order by ts, kind, id)),
arr as (select endpoint, ts, id as attempt_id, bad, ff, pp, dd, row_number() over w as n,
    coalesce((lag(pp) over w, lag(dd) over w) <> (pp, dd), false) and row_number() over w > 1 as fresh
  from inforce where kind = 1 window w as (partition by endpoint order by ts, id)),
run as (
  select endpoint, 0::bigint n, 'closed' st, 0::bigint c, null::timestamp until, null::bigint attempt_id, false called
  from (select distinct endpoint from arr)
  union all
  select endpoint, n,
    case when s1 = 'open' then 'open' when s1 = 'half-open' and bad then 'open'
         when s1 = 'half-open' and c1 + 1 >= pp then 'closed' when s1 = 'closed' and bad and c1 + 1 >= ff then 'open'
         else s1 end,
    case when s1 = 'open' then 0 when s1 = 'half-open' and (bad or c1 + 1 >= pp) then 0
         when s1 = 'half-open' then c1 + 1 when bad and c1 + 1 < ff then c1 + 1 else 0 end,
    case when s1 = 'open' then until when bad and (s1 = 'half-open' or c1 + 1 >= ff) then ts + to_seconds(dd) end,
    attempt_id, s1 <> 'open'
  from (select arr.*, until, case when fresh then 'closed' when st = 'open' and arr.ts > until then 'half-open' else st end s1,
          case when fresh or st = 'open' then 0 else c end c1
        from run join arr on arr.endpoint = run.endpoint and arr.n = run.n + 1))"""

# Attempts matched to outbox rows, and each row's attempts counted one by one.
_BREAKER_RUN = _REPLAY.removeprefix("with recursive ").replace("arr as", "tries as").replace("from arr)", "from tries)").replace("run as (", "breaker as (")
_BREAKER_RUN = _BREAKER_RUN.replace("run.", "breaker.").replace("from run join arr on", "from breaker join tries on").replace("arr.", "tries.")
_HISTORY = q(
    EVENTS,
    STORE
    + f""",
{_BREAKER_RUN},
owned as (select e.event_id as attempt_id, e.ts, {uuid_sql("md5(e.user_id || '_' || strftime(e.ts, '%Y%m%d'))")} as order_id,
    case when not b.called then 'rejected' when o.bad then 'failed' when o.code between 200 and 299 then 'delivered' else 'refused' end as result
  from events e join o on o.attempt_id = e.event_id join breaker b on b.attempt_id = e.event_id),
line as (select order_id, ts, 1 as kind, lpad(attempt_id::varchar, 20, '0') as id, attempt_id, result, null::varchar as made from owned
  union all select aggregate_id, created_at, 0, id, null, null, id from obx),
matched as (select *, last_value(made ignore nulls) over (partition by order_id order by ts, kind, id) as outbox_id from line),
mine as (select outbox_id, attempt_id, ts, result, row_number() over w as i, lead(ts) over w as next_ts
  from matched where kind = 1 and outbox_id is not null window w as (partition by outbox_id order by ts, attempt_id)),
walk as (
  select *, 1 as dispatch, 1 as attempt from mine where i = 1
  union all
  select m.*, w.dispatch + case when w.result in ('rejected', 'delivered') or w.attempt = 3 then 1 else 0 end,
    case when w.result in ('rejected', 'delivered') or w.attempt = 3 then 1 else w.attempt + 1 end
  from walk w join mine m on m.outbox_id = w.outbox_id and m.i = w.i + 1),
waits as (select *, case when result in ('rejected', 'delivered') then 0 else 5 * attempt end as wait_after from walk)""",
    """select outbox_id, attempt_id, ts, result, dispatch, attempt, wait_after,
         sum(wait_after) over (partition by outbox_id, dispatch order by attempt)::integer as waited,
         coalesce(result not in ('rejected', 'delivered') and attempt < 3 and next_ts < ts + to_seconds(wait_after), false) as early
       from waits""",
)

ORACLES = {
    "retry_history": _HISTORY,
    "breaker_replay_settings": _SETTINGS
    + " select endpoint, attempt_id, called, st as breaker_state from run where attempt_id is not null",
    "delivery_outcome": f"""with {_ATTEMPTS} select endpoint, case when bad then 'failed'
          when code between 200 and 299 then 'delivered' else 'refused' end as outcome, bad as breaker_failure,
          count(*) as n from o group by all""",
    "retry_schedule": q(
        EVENTS,
        STORE,
        """select id, a::integer as attempt, created_at + to_seconds(5 * a * (a - 1) // 2) as starts_at,
             (5 * a)::integer as wait_after, (5 * a * (a + 1) // 2)::integer as waited_total
           from obx, (select unnest([1, 2, 3]) a)""",
    ),
    "failure_streaks": f"""with {_ATTEMPTS}, r as (select *, row_number() over (partition by endpoint order by ts, attempt_id)
            - row_number() over (partition by endpoint, bad order by ts, attempt_id) grp from o)
          select endpoint, count(*) as failures, min(ts) as first_ts, max(ts) as last_ts, count(*) >= 5 as trips
          from r where bad group by endpoint, grp""",
    "breaker_replay": _REPLAY
    + " select endpoint, attempt_id, called, st as breaker_state from run where attempt_id is not null",
    "effective_config": """with c as (select event_id as version, ts, event_type,
            case when event_type <> 'error' and (json_extract_string(props, '$.k'))::bigint > 0
              then (json_extract_string(props, '$.k'))::bigint * case when event_type = 'purchase'
                and (json_extract_string(props, '$.k'))::bigint % 11 = 0 then 100000000 else 1 end end as ok from events)
          select version, ts,
            coalesce(last_value(case when event_type = 'signup' then ok end ignore nulls) over w, 5) as failure_threshold,
            coalesce(last_value(case when event_type = 'view' then ok end ignore nulls) over w, 2) as success_threshold,
            coalesce(last_value(case when event_type = 'click' then ok end ignore nulls) over w, 10) as timeout_seconds,
            coalesce(last_value(case when event_type = 'purchase' then ok end ignore nulls) over w, 30)
              as open_duration_seconds
          from c window w as (order by ts, version)""",
}
