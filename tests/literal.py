"""Row-by-row model of the whole pipeline, and builders for small logs."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import types as T

from seqloom.functions import vocabulary as v
from seqloom.operators.replay import Arrival, Lifetimes, PlanInMemory, expire, step

LOG = T.StructType(
    [
        T.StructField("plan_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("seq_id", T.IntegerType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("pos", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("total_amount", T.DoubleType()),
    ]
)
T0 = dt.datetime(2024, 1, 1)


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def event(pos, plan, order, seq, kind=None, payload=None, user=None, amount=None, ts=None):
    if kind is None:
        kind = v.SEQUENCED_TYPES[seq - 1] if seq and 1 <= seq <= 5 else "OrderCreated"
    payload = payload or f"e{pos:06d}"
    ts = ts or T0 + dt.timedelta(seconds=pos)
    return (plan, order, seq, payload, kind, ts, pos, payload, user, amount)


def steps(*spec, plan="plan_a", order=None, start=1, gap_seconds=1):
    """Steps in arrival order: an int, 'A' for a tombstone, or (seq, payload) / (seq, payload, kind)."""
    rows = []
    for i, item in enumerate(spec):
        pos = start + i
        ts = T0 + dt.timedelta(seconds=pos * gap_seconds)
        order_id = order or uid(1)
        if item == "A":
            rows.append(event(pos, plan, order_id, None, v.ABORT, ts=ts))
        elif isinstance(item, tuple):
            seq, payload, *kind = item
            rows.append(event(pos, plan, order_id, seq, *kind[:1], payload=payload, ts=ts))
        else:
            rows.append(event(pos, plan, order_id, item, ts=ts))
    return rows


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def random_log(seed, plans, longest=24, orders_per=0.6, faults=0.25, aborts=0.05):
    rng = random.Random(seed)
    rows = []
    n_orders = max(1, int(plans * orders_per))
    todo = [p for p in range(plans) for _ in range(rng.randint(1, longest))]
    rng.shuffle(todo)
    for pos, p in enumerate(todo, start=1):
        order = uid(p % n_orders)
        if rng.random() < aborts:
            rows.append(event(pos, f"plan_{p}", order, None, v.ABORT))
            continue
        seq = rng.randint(-1, 8) if rng.random() < 0.5 else rng.randint(1, 4)
        kind = "Mystery" if rng.random() < faults else rng.choice(v.SEQUENCED_TYPES)
        user = rng.choice([None, "u1", "u2"])
        amount = rng.choice([None, 1.5, 2.345, 10.0])
        payload = rng.choice(["x", "y", f"e{pos:06d}", f"z{rng.randint(0, 3)}"])
        rows.append(event(pos, f"plan_{p}", order, seq, kind, payload, user, amount))
    return rows


def refused(row):
    return v.STATUS_OF_EVENT.get(row[4], "") == ""


def run(rows, lifetimes=Lifetimes(), end=None):
    """(verdicts by pos, store state by order, outbox list, dead letters, applied list, buffers)."""
    plans, verdicts, applied, store, outbox, dead = {}, {}, [], {}, [], []
    skipped = []

    def micros(ts):
        return int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)

    def persist(row, now):
        plan, order, seq, event_id, kind, _, pos, _, user, amount = row
        if refused(row):
            dead.append((pos, v.DB_ERROR))
            return
        amount = None if amount is None else Decimal(str(amount)).quantize(Decimal("0.01"), "ROUND_HALF_UP")
        if order not in store:
            store[order] = [user or "unknown", "", None, "", None, now, now]
        elif store[order][4] is not None and seq <= store[order][4]:
            skipped.append(pos)
            return
        state = store[order]
        state[1] = v.STATUS_OF_EVENT[kind]
        state[2] = amount if amount is not None else state[2]
        state[3], state[4], state[6] = plan, seq, now
        outbox.append((order, kind, event_id))

    for row in sorted(rows, key=lambda r: r[6]):
        plan_id, order, seq, event_id, kind, ts, pos, payload, _, _ = row
        if kind != v.ABORT and seq is None:
            dead.append((pos, v.MISSING_SEQ_ID))
            continue
        plan = plans.setdefault(plan_id, PlanInMemory())
        tombstone = kind == v.ABORT
        out = step(
            plan,
            Arrival(pos, None if tombstone else seq, payload, micros(ts), refused(row), row),
            lifetimes,
        )
        dead.extend((m.pos, v.BUFFER_TIMEOUT) for m in out.expired)
        if tombstone:
            if order in store and store[order][1] != "aborted":
                store[order][1], store[order][6] = "aborted", ts
            outbox.append((order, v.ABORT, event_id))
            continue
        verdicts[pos] = out.verdict
        for member in out.applied:
            applied.append((plan_id, member.seq, member.pos, pos))
            persist(member.row, ts)
    if end is not None:
        for plan in plans.values():
            dead.extend((m.pos, v.BUFFER_TIMEOUT) for m in expire(plan, micros(end), lifetimes))
    left = sorted(m.pos for p in plans.values() for m in p.empty_out())
    counters = {name: p.counter for name, p in plans.items()}
    return {
        "verdicts": verdicts,
        "store": {k: tuple(s) for k, s in store.items()},
        "outbox": sorted(outbox),
        "dead": sorted(dead),
        "applied": sorted(applied),
        "left": left,
        "counters": counters,
        "skipped": sorted(skipped),
    }
