"""The sequence gate as a keyed stream operator, with event-time timers.

State per plan: the counter, the abort deadline, and the waiting room: in the
plan's own value up to ROOM members, beyond that as one head (smallest payload)
per step plus the twins that wait behind it. What an event does is decided by
``replay.step``, as in batch.

The operator's keys are BUCKETS hashes of plan ids, and a plan is an entry of its
bucket's state: what Spark does once per key and micro-batch (hand the key over,
return a record batch) is shared by all plans of a bucket. A plan is read and
written once per micro-batch, whatever it is sent.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqloom.functions import vocabulary as v
from seqloom.operators import orders
from seqloom.operators.lifetimes import STANDARD
from seqloom.operators.replay import Arrival, Lifetimes, PlanInMemory, expire, step

EVENT = (
    "order_id string, seq_id bigint, event_id string, event_type string, ts timestamp, pos bigint, "
    "payload string, user_id string, total_amount double, persist_error string"
)
FIELDS = [part.split()[0] for part in EVENT.split(", ")]
# kind: verdict (one per arrival), applied, abort, timeout; of records that do not get to the gate: rejected
OUTPUT = f"kind string, plan_id string, {EVENT}, verdict string, applied_pos bigint, applied_ts timestamp"
OUT_ROW = Row(*[part.split()[0] for part in OUTPUT.split(", ")])
# Waiting events that a plan's own value may hold.
ROOM = 64
PLAN = (
    "counter bigint, abort_until bigint, last_add bigint, timer bigint, spilled boolean, "
    f"room array<struct<{', '.join(part.replace(' ', ': ') for part in EVENT.split(', '))}>>"
)
BUCKETS = 8192
EPOCH = dt.datetime(1970, 1, 1)


def _micros(ts: dt.datetime) -> int:
    return (ts.replace(tzinfo=None) - EPOCH) // dt.timedelta(microseconds=1)


_POS, _SEQ, _TYPE, _TS, _PAYLOAD, _ERROR = (FIELDS.index(f) for f in ("pos", "seq_id", "event_type", "ts", "payload", "persist_error"))


def _arrival(carried: tuple) -> Arrival:
    """From the values of FIELDS."""
    seq = None if carried[_TYPE] == v.ABORT else carried[_SEQ]
    return Arrival(carried[_POS], seq, carried[_PAYLOAD], _micros(carried[_TS]), carried[_ERROR] is not None, carried)


def entry(state, key: tuple):
    """The value of a key, or None; asked for first, as Spark logs a warning for each value that is not there."""
    return state.getValue(key) if state.containsKey(key) else None


class _PlanInState(PlanInMemory):
    """What ``step`` needs of a plan: an entry of its bucket's state, and entries per waiting event where it has many."""

    def __init__(self, plan_id, plans, heads, twins):
        super().__init__()
        self._id, self._plans, self._heads, self._twins = plan_id, plans, heads, twins
        known = entry(plans, (plan_id,))
        self.timer, self._spilled = None, False
        if known:
            self.counter, self.abort_until, self.last_add, self.timer, self._spilled, room = known
            for row in room or ():
                super().put(_arrival(tuple(row)))
        self._changed, self._saved = known is None, self._scalars()

    def _scalars(self) -> tuple:
        return self.counter, self.abort_until, self.last_add, self.timer, self._spilled

    def put(self, arrival: Arrival) -> None:
        self._changed = True
        if not self._spilled:
            return super().put(arrival)
        key = (self._id, arrival.seq)
        if not self._heads.containsKey(key):
            self._heads.updateValue(key, arrival.row)
            return None
        head = tuple(self._heads.getValue(key))
        kept = head[_PAYLOAD]
        if arrival.payload < kept:
            self._heads.updateValue(key, arrival.row)
            self._twins.updateValue((*key, kept), head)
        elif arrival.payload > kept and not self._twins.containsKey((*key, arrival.payload)):
            self._twins.updateValue((*key, arrival.payload), arrival.row)
        return None

    def take(self, seq: int) -> Arrival | None:
        if not self._spilled:
            taken = super().take(seq)
            self._changed |= taken is not None
            return taken
        key = (self._id, seq)
        if not self._heads.containsKey(key):
            return None
        head = tuple(self._heads.getValue(key))
        self._heads.removeKey(key)
        return _arrival(head)

    def empty_out(self) -> list[Arrival]:
        members = super().empty_out()
        self._changed |= bool(members)
        if self._spilled:
            # Only rooms of more than ROOM members are looked through.
            for state in (self._heads, self._twins):
                mine = [(tuple(key), tuple(row)) for key, row in state.iterator() if key[0] == self._id]
                for key, row in mine:
                    state.removeKey(key)
                    members.append(_arrival(row))
            self._spilled = False
        return members

    def save(self) -> None:
        if len(members := self.members()) > ROOM:
            self._waiting, self._spilled = {}, True
            for member in members:
                self.put(member)
            members = []
        if self._changed or self._scalars() != self._saved:
            self._plans.updateValue((self._id,), (*self._scalars(), [member.row for member in members]))


class PlanGate(StatefulProcessor):
    def __init__(self, lifetimes: Lifetimes):
        self._lifetimes = lifetimes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._plans = handle.getMapState("plan", "plan_id string", PLAN)
        self._heads = handle.getMapState("heads", "plan_id string, seq bigint", EVENT)
        self._twins = handle.getMapState("twins", "plan_id string, seq bigint, payload string", EVENT)
        # Plans that a timer of the bucket is for.
        self._due = handle.getMapState("due", "at bigint", "plans array<string>")

    def _plan(self, plan_id) -> _PlanInState:
        return _PlanInState(plan_id, self._plans, self._heads, self._twins)

    def _deadline(self, plan: _PlanInState) -> int | None:
        if self._lifetimes.buffer is None or plan.last_add is None:
            return None
        return -(-(plan.last_add + self._lifetimes.buffer) // 1000)

    def _close(self, plan_id, plan: _PlanInState) -> None:
        """One timer per plan at a time; one that comes before the waiting room's time is up sets the next."""
        wanted = self._deadline(plan)
        if wanted is not None and (plan.timer is None or wanted < plan.timer):
            due = entry(self._due, (wanted,))
            if due is None:
                self._handle.registerTimer(wanted)
            self._due.updateValue((wanted,), ([*(due[0] if due else ()), plan_id],))
            plan.timer = wanted
        plan.save()

    def handleInputRows(self, key, rows, timerValues):
        plans = {}
        for row in rows:
            carried = tuple(row[-len(FIELDS) :])
            if row["reject"] is None:
                plans.setdefault(row["plan_id"], []).append(carried)
            else:
                yield OUT_ROW("rejected", row["plan_id"], *carried, row["reject"], None, None)
        # Rows of one micro-batch come in no order; a batch is bounded by the
        # source's per-trigger limit.
        for plan_id, routable in plans.items():
            plan = self._plan(plan_id)
            for carried in sorted(routable, key=lambda r: r[_POS]):
                arrival = _arrival(carried)
                outcome = step(plan, arrival, self._lifetimes)
                for member in outcome.expired:
                    yield _out("timeout", plan_id, member)
                kind = "abort" if arrival.seq is None else "verdict"
                yield _out(kind, plan_id, arrival, outcome.verdict)
                for member in outcome.applied:
                    yield _out("applied", plan_id, member, None, arrival)
            self._close(plan_id, plan)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = entry(self._due, (at,))
        self._due.removeKey((at,))
        for plan_id in due[0] if due else ():
            plan = self._plan(plan_id)
            if plan.timer != at:
                continue
            plan.timer = None
            # A deadline that has moved since may be over as well.
            until = self._deadline(plan)
            if until is not None and until <= timerValues.getCurrentWatermarkInMs():
                for member in expire(plan, until * 1000, self._lifetimes):
                    yield _out("timeout", plan_id, member)
            self._close(plan_id, plan)


def _out(kind, plan_id, arrival: Arrival, verdict=None, moved_by: Arrival | None = None) -> Row:
    reached = (moved_by.pos, moved_by.row[_TS]) if moved_by else (None, None)
    return OUT_ROW(kind, plan_id, *arrival.row, verdict, *reached)


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _gated(rows: DataFrame, lifetimes: Lifetimes, delay: str) -> DataFrame:
    """Rows with ``gate_key`` and ``reject`` through the gate.

    The watermark drives timers only. No event is too late to be judged: what the
    operator gets is a plain copy of the time stamp, which carries no watermark
    that late rows could be measured by.
    """
    timed = (
        rows.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .withColumn("ts", F.timestamp_micros(F.unix_micros("ts")))
        .select("gate_key", "plan_id", "reject", *FIELDS)
    )
    return timed.groupBy("gate_key").transformWithState(
        statefulProcessor=PlanGate(lifetimes),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )


def gate_stream(
    log: DataFrame, lifetimes: Lifetimes = STANDARD, delay: str = "10 minutes"
) -> DataFrame:
    """Verdicts, applied events, tombstones and timeouts of a streaming log, tagged by ``kind``."""
    routable = log.filter((F.col("event_type") == v.ABORT) | F.col("seq_id").isNotNull())
    rows = orders.with_persist_error(routable).withColumns(
        {"gate_key": bucket_of(F.col("plan_id")), "reject": F.lit(None).cast("string")}
    )
    return _gated(rows, lifetimes, delay)


def gate_records(
    typed: DataFrame, lifetimes: Lifetimes = STANDARD, delay: str = "10 minutes"
) -> DataFrame:
    """The same of every parsed record (``wire.typed_rows``), the unreadable and stepless ones as ``rejected``.

    Those pass through the operator without touching state, dealt out by their
    positions; ``verdict`` is then the error code, and ``payload`` the raw text of
    what cannot be read.
    """
    missing = F.col("seq_id").isNull() & (F.col("event_type") != v.ABORT)
    reject = F.when(~F.col("parse_ok"), F.lit(v.PARSE_ERROR)).when(missing, F.lit(v.MISSING_SEQ_ID))
    rows = typed.withColumn("reject", reject).withColumn("payload", F.coalesce("raw", "payload"))
    error = F.when(F.col("reject").isNull(), F.col("persist_error"))
    rows = orders.with_persist_error(rows).withColumn("persist_error", error)
    key = F.when(F.col("reject").isNull(), F.col("plan_id")).otherwise(F.col("pos").cast("string"))
    return _gated(rows.withColumn("gate_key", bucket_of(key)), lifetimes, delay)
