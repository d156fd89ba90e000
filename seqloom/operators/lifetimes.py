"""The gate under the clock: waiting rooms that time out, tombstones that lapse.

A waiting room is emptied to the dead letters when an event of its plan comes a
whole lifetime after the last event that was added to it, or when the log ends
that long after it. A tombstone stops its plan for a lifetime; afterwards the plan
goes on behind its counter.

Where neither can have happened before the end of the log, the closed form of the
gate holds, and only what still waits at the end is compared with the clock. A
plan is left to the event-by-event form if some event of it comes a lifetime after
the latest time stamp that any earlier event was added with, or after a tombstone:
a running maximum over its positions, in ranges where the plan is hot. Those plans
are replayed as a sorted stream: a task holds the waiting room of the current plan
and nothing else, however long the plan is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import vocabulary as v
from seqloom.operators import orders, replay, sequence, skew
from seqloom.operators.replay import Lifetimes

STANDARD = Lifetimes(abort=v.ABORT_TTL_SECONDS * 1_000_000, buffer=v.BUFFER_TTL_SECONDS * 1_000_000)
PLAN = ["plan_id"]
_NAMES = [part.split()[0] for part in replay.FACTS.split(", ")]


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def end_of(log: DataFrame, delay: dt.timedelta) -> int | None:
    """Where a stream's clock stands after the whole log: the latest time stamp less the delay, in microseconds."""
    latest = log.agg(F.max(_micros("ts"))).first()[0]
    return None if latest is None else latest - delay // dt.timedelta(microseconds=1)


def clocked_plans(gated: DataFrame, lifetimes: Lifetimes, hot: DataFrame | None) -> DataFrame:
    """The plans of a gated log whose closed form the clock may contradict."""
    added = F.when(F.col("verdict") == v.OUT_OF_ORDER, F.col("_at"))
    stopped = F.when(F.col("event_type") == v.ABORT, F.col("_at"))
    narrow = gated.select(*PLAN, "pos", _micros("ts").alias("_at"), "verdict", "event_type")
    narrow = narrow.withColumns({"_added": added, "_stopped": stopped})

    def late(df: DataFrame) -> DataFrame:
        """A running minimum of the tombstones: the first to lapse tells."""
        never = F.lit(False)
        idle = never if lifetimes.buffer is None else F.col("_at") >= F.col("_last_add") + lifetimes.buffer
        lapsed = never if lifetimes.abort is None else F.col("_at") >= F.col("_first_stop") + lifetimes.abort
        return df.filter(F.coalesce(idle, never) | F.coalesce(lapsed, never)).select(*PLAN)

    def ordinary(df: DataFrame) -> DataFrame:
        before = Window.partitionBy(*PLAN).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        return late(df.withColumns({"_last_add": F.max("_added").over(before), "_first_stop": F.min("_stopped").over(before)}))

    def ranged(df: DataFrame) -> DataFrame:
        df = skew.chunked(df, PLAN, "pos")
        specs = {"_last_add": ("max", F.col("_added")), "_first_stop": ("min", F.col("_stopped"))}
        return late(skew.running(df, PLAN, F.col("_chunk"), ["pos"], specs))

    return skew.both(narrow, PLAN, hot, ordinary, ranged).distinct()


def gate_by_the_clock(log: DataFrame, lifetimes: Lifetimes = STANDARD, end: int | None = None) -> DataFrame:
    """Verdicts, applied events, tombstones and timeouts of a log, tagged by ``kind`` as the stream's are.

    ``end`` is the clock after the log in microseconds (``end_of``); without it nothing times out at the end.
    """
    rows = orders.with_persist_error(log)
    hot = skew.hot_keys(log, PLAN)
    gated = skew.stage(sequence.seq_gate(rows, store_faults=True))
    clocked = skew.stage(clocked_plans(gated, lifetimes, hot))
    plain = gated.join(clocked, PLAN, "left_anti")

    def facts(df: DataFrame, kind) -> DataFrame:
        kept = {"kind": kind, "seq_id": F.when(F.col("event_type") != v.ABORT, F.col("seq_id")).cast("bigint")}
        return df.withColumns(kept).select(*_NAMES)

    no_pos = {"applied_pos": F.lit(None).cast("bigint")}
    arrivals = facts(plain.withColumns(no_pos), F.when(F.col("event_type") == v.ABORT, F.lit("abort")).otherwise(F.lit("verdict")))
    applied = facts(plain.filter("applied").withColumn("verdict", F.lit(None).cast("string")), F.lit("applied"))
    out = arrivals.unionByName(applied)
    if lifetimes.buffer is not None and end is not None:
        room = sequence.still_buffered(plain)
        last = plain.filter(F.col("verdict") == v.OUT_OF_ORDER).groupBy(*PLAN).agg(F.max(_micros("ts")).alias("_last_add"))
        left = room.drop("applied_pos").join(last.filter(F.col("_last_add") + lifetimes.buffer <= end), PLAN)
        blank = {"verdict": F.lit(None).cast("string"), "event_type": F.lit(""), **no_pos}
        out = out.unionByName(facts(left.withColumns(blank), F.lit("timeout")))

    routable = rows.filter((F.col("event_type") == v.ABORT) | F.col("seq_id").isNotNull())
    again = routable.join(clocked, PLAN, "left_semi").withColumns({"_at": _micros("ts"), "_refused": F.col("persist_error").isNotNull()})
    return out.unionByName(replay.streamed(again, lifetimes, end))


def timeout_letters(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "timeout").select(
        F.col("order_id").alias("key"),
        "plan_id",
        "seq_id",
        "payload",
        "pos",
        F.lit(v.REASON_TIMEOUT).alias("error_reason"),
        F.lit(v.BUFFER_TIMEOUT).alias("error_code"),
        F.col("event_id").alias("original_event_id"),
    )


def resumed(facts: DataFrame) -> DataFrame:
    """Events that reached the store behind a tombstone of their plan: it had lapsed."""
    first = facts.filter("kind = 'abort'").groupBy(*PLAN).agg(F.min("pos").alias("_stop"))
    applied = facts.filter("kind = 'applied'").join(first, PLAN)
    return applied.filter(F.col("applied_pos") > F.col("_stop")).select("plan_id", "seq_id", "pos", "applied_pos")
