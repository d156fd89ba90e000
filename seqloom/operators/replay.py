"""Event-by-event form of the gate, for what the closed form leaves out.

``step`` is the one place that says what a single event does. The batch replay,
the stream processor and the tests all use it; they differ only in where the
plan's state lives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqloom.functions import vocabulary as v


FOREVER = 2**62  # later than any time stamp, and still a BIGINT


class Arrival(NamedTuple):
    pos: int
    seq: int | None  # None for a tombstone
    payload: str
    ts: int  # microseconds
    refused: bool  # the store will not take it
    row: object = None  # carried along untouched


class Lifetimes(NamedTuple):
    """Microseconds; None means forever."""

    abort: int | None = None
    buffer: int | None = None


class Outcome(NamedTuple):
    verdict: str | None
    applied: list  # arrivals handed to the store, in order
    expired: list  # waiting arrivals that timed out


class PlanInMemory:
    """State of one plan: counter, abort flag and waiting room."""

    def __init__(self):
        self.counter = 0
        self.abort_until = None
        self.last_add = None
        self._waiting: dict[int, dict[str, Arrival]] = {}

    def put(self, arrival: Arrival) -> None:
        self._waiting.setdefault(arrival.seq, {}).setdefault(arrival.payload, arrival)

    def take(self, seq: int) -> Arrival | None:
        members = self._waiting.get(seq)
        if not members:
            return None
        first = members.pop(min(members))
        if not members:
            del self._waiting[seq]
        return first

    def members(self) -> list:
        return [a for _, group in sorted(self._waiting.items()) for _, a in sorted(group.items())]

    def empty_out(self) -> list:
        members = self.members()
        self._waiting = {}
        return members


def expire(plan, now: int, lifetimes: Lifetimes) -> list:
    """Members whose plan saw no new waiting event for a whole buffer lifetime."""
    if lifetimes.buffer is None or plan.last_add is None:
        return []
    if now < plan.last_add + lifetimes.buffer:
        return []
    plan.last_add = None
    return plan.empty_out()


def step(plan, arrival: Arrival, lifetimes: Lifetimes = Lifetimes()) -> Outcome:
    expired = expire(plan, arrival.ts, lifetimes)
    if arrival.seq is None:
        plan.abort_until = FOREVER if lifetimes.abort is None else arrival.ts + lifetimes.abort
        plan.empty_out()
        plan.last_add = None
        return Outcome(None, [], expired)
    if plan.abort_until is not None and arrival.ts < plan.abort_until:
        return Outcome(v.ABORTED, [], expired)
    if arrival.seq <= plan.counter:
        return Outcome(v.DUPLICATE, [], expired)
    if arrival.seq > plan.counter + 1:
        plan.put(arrival)
        # An event that comes late by its own clock does not shorten the others' wait.
        plan.last_add = arrival.ts if plan.last_add is None else max(plan.last_add, arrival.ts)
        return Outcome(v.OUT_OF_ORDER, [], expired)
    plan.counter = arrival.seq
    applied = [arrival]
    if not arrival.refused:
        while (waiting := plan.take(plan.counter + 1)) is not None:
            plan.counter += 1
            applied.append(waiting)
    return Outcome(v.OK, applied, expired)


def _replay_one(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos", kind="stable").reset_index(drop=True)
    plan = PlanInMemory()
    verdicts, reached, taken = [], {}, set()
    fields = zip(
        rows["pos"], rows["seq_id"], rows["event_type"], rows["payload"], rows["_poison"], strict=True
    )
    for at, (pos, seq, kind, payload, poison) in enumerate(fields):
        tombstone = kind == v.ABORT
        arrival = Arrival(pos, None if tombstone else int(seq), payload, at, bool(poison))
        outcome = step(plan, arrival)
        verdicts.append(outcome.verdict)
        for member in outcome.applied:
            reached[member.seq] = at
            taken.add(member.pos)
    # Only live steps count as reached, for each row of the step.
    index = [
        None if kind == v.ABORT else reached.get(int(seq))
        for seq, kind in zip(rows["seq_id"].fillna(0), rows["event_type"], strict=True)
    ]
    known = [i is not None for i in index]
    at = [i or 0 for i in index]
    rows["verdict"] = verdicts
    rows["applied_pos"] = rows["pos"].iloc[at].reset_index(drop=True).astype("Int64").where(known)
    rows["applied_ts"] = rows["ts"].iloc[at].reset_index(drop=True).where(known)
    rows["applied"] = rows["pos"].isin(taken)
    return rows


def replay_plans(rows: DataFrame) -> DataFrame:
    """Replay whole plans in arrival order. Callers pass no hot plans, so a
    group is at most ``skew.hot_rows`` rows."""
    added = [
        T.StructField("verdict", T.StringType()),
        T.StructField("applied_pos", T.LongType()),
        T.StructField("applied_ts", rows.schema["ts"].dataType),
        T.StructField("applied", T.BooleanType()),
    ]
    schema = T.StructType([*rows.schema.fields, *added])
    return rows.groupBy("plan_id").applyInPandas(_replay_one, schema)


# kind: verdict (one per arrival), applied, abort, timeout
FACTS = (
    "kind string, plan_id string, order_id string, seq_id bigint, event_id string, payload string, pos bigint, "
    "verdict string, applied_pos bigint"
)
_FACT_NAMES = [part.split()[0] for part in FACTS.split(", ")]
_FACT_INPUT = ["plan_id", "order_id", "seq_id", "event_id", "event_type", "payload", "pos", "_at", "_refused"]


def _streamed(lifetimes: Lifetimes, end: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, name, out = PlanInMemory(), None, []

        def say(kind: str, plan_id: str, member: Arrival, verdict=None, applied_pos=None) -> None:
            order_id, event_id = member.row
            out.append((kind, plan_id, order_id, member.seq, event_id, member.payload, member.pos, verdict, applied_pos))

        def finish() -> None:
            if name is not None and end is not None:
                for member in expire(plan, end, lifetimes):
                    say("timeout", name, member)

        def ready() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=_FACT_NAMES).astype({"seq_id": "Int64", "pos": "Int64", "applied_pos": "Int64"})
            out.clear()
            return frame

        for frame in frames:
            for plan_id, order_id, seq, event_id, kind, payload, pos, at, refused in frame[_FACT_INPUT].itertuples(index=False, name=None):
                if plan_id != name:
                    finish()
                    plan, name = PlanInMemory(), plan_id
                tombstone = kind == v.ABORT
                arrival = Arrival(int(pos), None if tombstone else int(seq), payload, int(at), bool(refused), (order_id, event_id))
                outcome = step(plan, arrival, lifetimes)
                for member in outcome.expired:
                    say("timeout", plan_id, member)
                say("abort" if tombstone else "verdict", plan_id, arrival, outcome.verdict)
                for member in outcome.applied:
                    say("applied", plan_id, member, None, int(pos))
            yield ready()
        finish()
        yield ready()

    return run


def streamed(rows: DataFrame, lifetimes: Lifetimes = Lifetimes(), end: int | None = None) -> DataFrame:
    """Replay plans of any size: each is a sorted stream through one task, which holds its waiting room and nothing else.

    Rows need ``_at`` (microseconds) and ``_refused``; what comes back are facts, not rows.
    """
    ordered = rows.select(*_FACT_INPUT).repartition("plan_id").sortWithinPartitions("plan_id", "pos")
    return ordered.mapInPandas(_streamed(lifetimes, end), FACTS)
