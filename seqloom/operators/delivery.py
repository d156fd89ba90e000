"""Outbox delivery as data work: batches, receipts, outcomes, retries, breaker."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import vocabulary as v
from seqloom.operators import skew

ENDPOINT = ["endpoint"]


def outbox_next_batch(outbox: DataFrame, n: int = v.OUTBOX_BATCH) -> DataFrame:
    """Oldest unprocessed rows; the id breaks ties."""
    return outbox.filter(~F.col("processed")).orderBy("created_at", "id").limit(n)


def outbox_mark(outbox: DataFrame, receipts: DataFrame) -> DataFrame:
    """Flag rows that have a receipt (column ``id``)."""
    got = receipts.select("id").distinct().withColumn("_got", F.lit(True))
    marked = outbox.join(got, "id", "left")
    return marked.withColumn(
        "processed", F.col("processed") | F.coalesce("_got", F.lit(False))
    ).drop("_got")


def _failed() -> Column:
    return F.coalesce(F.col("transport_error"), F.lit(False)) | (F.col("status_code") >= 500)


def delivery_outcome(attempts: DataFrame) -> DataFrame:
    """``delivered``: 2xx. ``breaker_failure``: no answer, or 5xx. Other answers
    are failed deliveries the breaker counts as successes."""
    ok = F.col("status_code").between(200, 299)
    return attempts.withColumns(
        {
            "breaker_failure": F.coalesce(_failed(), F.lit(False)),
            "outcome": F.when(F.coalesce(_failed(), F.lit(False)), F.lit("failed"))
            .when(ok, F.lit("delivered"))
            .otherwise(F.lit("refused")),
        }
    )


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def retry_schedule(
    outbox: DataFrame, attempts: int = v.RETRY_MAX, delay: int = v.RETRY_DELAY_SECONDS
) -> DataFrame:
    """When each attempt of an undeliverable row starts; the wait grows linearly
    and also follows the last attempt."""
    n = F.col("attempt")
    waited = (n * (n - 1) / 2).cast("int") * delay
    rows = outbox.select(
        "id", "created_at", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt")
    )
    return rows.select(
        "id",
        "attempt",
        (F.col("created_at") + F.make_dt_interval(secs=waited)).alias("starts_at"),
        (n * delay).alias("wait_after"),
        (waited + n * delay).alias("waited_total"),
    )


def matched_attempts(outbox: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts (with ``order_id``) with the outbox row they were made for: the last of their order created before them.

    Attempts of orders without such a row are left out. Rows and attempts of an order lie in one order; a hot one is cut
    into ranges.
    """
    rows = outbox.select(F.col("aggregate_id").alias("_order"), F.col("created_at").alias("_ts"), F.lit(0).alias("_kind"), F.col("id").alias("_id"))
    made = attempts.select(
        F.col("order_id").alias("_order"), F.col("ts").alias("_ts"), F.lit(1).alias("_kind"),
        F.lpad(F.col("attempt_id").cast("string"), 20, "0").alias("_id"), F.struct("*").alias("_row"),
    )
    both = made.unionByName(rows, allowMissingColumns=True).withColumns(
        {"_at": F.unix_micros(F.col("_ts").cast("timestamp")), "_made": F.when(F.col("_kind") == 0, F.col("_id"))}
    )
    order = ["_ts", "_kind", "_id"]

    def ordinary(df: DataFrame) -> DataFrame:
        upto = Window.partitionBy("_order").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("outbox_id", F.last("_made", ignorenulls=True).over(upto))

    def hot(df: DataFrame) -> DataFrame:
        return skew.running(skew.chunked(df, ["_order"], "_at"), ["_order"], F.col("_chunk"), order, {"outbox_id": ("last", F.col("_made"))}).drop("_chunk")

    found = skew.both(both, ["_order"], skew.hot_keys(both, ["_order"]), ordinary, hot)
    return found.filter("_kind = 1 and outbox_id is not null").select("_row.*", "outbox_id")


def retry_history(
    attempts: DataFrame, most: int = v.RETRY_MAX, delay: int = v.RETRY_DELAY_SECONDS
) -> DataFrame:
    """What every attempt for an outbox row was, told from the attempts that were made.

    Takes attempts with ``outbox_id``, ``called`` (``breaker_replay``) and the answer. A dispatch makes up to ``most``
    attempts; it ends with an answer that delivers, with the last attempt, or at once where the open breaker rejects the
    call. The next attempt of the row then begins a new dispatch. Adds ``dispatch`` and ``attempt`` (from 1), ``result``,
    ``wait_after`` (linear, also behind the last attempt; none behind a delivery or a rejection), ``waited`` in the
    dispatch so far, and ``early``: the next attempt of the dispatch came before the wait was over.
    """
    rows = delivery_outcome(attempts).withColumns(
        {
            "result": F.when(F.col("called"), F.col("outcome")).otherwise(F.lit("rejected")),
            "_micros": _micros(),
        }
    )
    rows = rows.withColumn("_ends", F.col("result").isin("rejected", "delivered"))
    key, order = ["outbox_id"], ["ts", "attempt_id"]

    def told(df: DataFrame) -> DataFrame:
        """From the place of the attempt, of the last end before it, and the whole dispatches before that."""
        since = F.col("_place") - F.coalesce("_last_end", F.lit(-1)) - 1
        attempt = since % most + 1
        waits = (F.col("_ends") == F.lit(False)).cast("int") * delay * attempt
        before = (attempt * (attempt - 1) / 2).cast("int") * delay
        # Of a stretch between two ends, every `most` attempts are a dispatch.
        return df.withColumns(
            {
                "attempt": attempt.cast("int"),
                "begins": (attempt == 1).cast("int"),
                "wait_after": waits.cast("int"),
                "waited": (before + waits).cast("int"),
                "early": F.coalesce(~F.col("_ends") & (attempt < most) & (F.col("_next") < F.col("_micros") + waits * 1_000_000), F.lit(False)),
            }
        )

    def ordinary(df: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*key).orderBy(*order)
        before = upto.rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumns({"_place": F.row_number().over(upto) - 1, "_next": F.lead("_micros").over(upto)})
        df = told(df.withColumn("_last_end", F.max(F.when(F.col("_ends"), F.col("_place"))).over(before)))
        return df.withColumn("dispatch", F.sum("begins").over(upto.rowsBetween(Window.unboundedPreceding, 0)))

    def hot(df: DataFrame) -> DataFrame:
        """The same in ranges; the next attempt is the first value behind, scanned backwards."""
        chunked = skew.chunked(df, key, "_micros")
        df = skew.running(chunked, key, F.col("_chunk"), order, {"_place": ("sum", F.lit(1))})
        df = skew.running(df, key, F.col("_chunk"), order, {"_next": ("last", F.col("_micros"))}, descending=True)
        df = told(skew.running(df, key, F.col("_chunk"), order, {"_last_end": ("max", F.when(F.col("_ends"), F.col("_place")))}))
        df = skew.running(skew.cut(df), key, F.col("_chunk"), order, {"dispatch": ("sum", F.col("begins"))})
        return df.withColumn("dispatch", F.col("dispatch") + F.col("begins")).drop("_chunk")

    kept = ["outbox_id", "attempt_id", "ts", "result", "dispatch", "attempt", "wait_after", "waited", "early"]
    out = skew.both(rows, key, skew.hot_keys(rows, key), ordinary, hot)
    return out.select(*kept)


def failure_streaks(attempts: DataFrame, threshold: int) -> DataFrame:
    """Runs of consecutive breaker failures per endpoint, and whether they trip it.

    A run is named by the number of successes before it.
    """
    rows = delivery_outcome(attempts).withColumn("_micros", _micros())
    success = F.when(F.col("breaker_failure"), 0).otherwise(1)

    def ordinary(df: DataFrame) -> DataFrame:
        before = Window.partitionBy(*ENDPOINT).orderBy("ts", "attempt_id")
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_run", F.coalesce(F.sum(success).over(before), F.lit(0)))

    def hot(df: DataFrame) -> DataFrame:
        df = skew.chunked(df, ENDPOINT, "_micros")
        order = ["ts", "attempt_id"]
        return skew.running(df, ENDPOINT, F.col("_chunk"), order, {"_run": ("sum", success)})

    runs = skew.both(rows, ENDPOINT, skew.hot_keys(attempts, ENDPOINT), ordinary, hot)
    return (
        runs.filter("breaker_failure")
        .groupBy(*ENDPOINT, "_run")
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .withColumn("trips", F.col("failures") >= threshold)
        .drop("_run")
    )


def effective_config(changes: DataFrame) -> DataFrame:
    """Settings in force after each change: the last valid value of every key.

    Absent, zero, negative and unreadable values keep what was there. The log is
    scanned in ranges of bounded size, with one carried row per range.
    """
    number = F.col("value").try_cast("bigint")
    # Counts are unsigned 32-bit numbers, durations signed 64-bit ones.
    count = F.col("value").rlike("^[0-9]+$") & number.between(1, 2**32 - 1)
    seconds = F.col("value").rlike("^[+-]?[0-9]+$") & (number > 0)
    valid = {
        k: F.when((F.col("key") == k) & (seconds if k.endswith("_seconds") else count), number)
        for k in v.BREAKER_DEFAULTS
    }
    scanned = skew.running(
        skew.ranged(changes, ["ts", "version"]),
        [],
        F.col("_range"),
        ["ts", "version"],
        {f"_{k}": ("last", column) for k, column in valid.items()},
    )
    return scanned.select(
        "version",
        "ts",
        *[
            F.coalesce(valid[k], F.col(f"_{k}"), F.lit(default)).cast("bigint").alias(k)
            for k, default in v.BREAKER_DEFAULTS.items()
        ],
    )


SETTINGS = list(v.BREAKER_DEFAULTS)


def with_settings(attempts: DataFrame, changes: DataFrame) -> DataFrame:
    """Attempts with the settings in force when they start; a change counts from its own instant on.

    An as-of join without a key: attempts and changes in one order, cut into ranges, each attempt taking the last change
    before it.
    """
    settings = effective_config(changes).select(
        F.col("ts").alias("_ts"), F.lit(0).alias("_kind"), F.col("version").alias("_id"), F.struct(*SETTINGS).alias("_set")
    )
    events = attempts.select(F.col("ts").alias("_ts"), F.lit(1).alias("_kind"), F.col("attempt_id").alias("_id"), F.struct("*").alias("_row"))
    order = ["_ts", "_kind", "_id"]
    both = skew.ranged(events.unionByName(settings, allowMissingColumns=True), order)
    found = skew.running(both, [], F.col("_range"), order, {"_now": ("last", F.col("_set"))}).filter("_kind = 1")
    in_force = {n: F.coalesce(F.col(f"_now.{n}"), F.lit(default)).cast("bigint") for n, default in v.BREAKER_DEFAULTS.items()}
    return found.select("_row.*", *[c.alias(n) for n, c in in_force.items()])


CLOSED, OPEN, HALF_OPEN = 0, 1, 2
_NAMES = {CLOSED: "closed", OPEN: "open", HALF_OPEN: "half-open"}
#: An attempt as the breaker sees it: when, whether it fails, the three settings, and whether the breaker is made anew.
_SEEN = ["_micros", "breaker_failure", "failure_threshold", "success_threshold", "_open", "_fresh"]


class Breaker:
    """closed -> open -> half-open -> closed, as (mode, count, open until)."""

    def __init__(self, mode=CLOSED, count=0, until=0):
        self.mode, self.count, self.until = mode, count, until

    def call(self, now: int, failed: bool, failures: int, probes: int, open_micros: int) -> bool:
        """False when the breaker rejects the call without making it."""
        if self.mode == OPEN:
            if now <= self.until:
                return False
            self.mode, self.count = HALF_OPEN, 0
        if failed:
            self.count = self.count + 1 if self.mode == CLOSED else failures
            if self.count >= failures:
                self.mode, self.count, self.until = OPEN, 0, now + open_micros
        elif self.mode == HALF_OPEN:
            self.count += 1
            if self.count >= probes:
                self.mode, self.count = CLOSED, 0
        else:
            self.count = 0
        return True


State = tuple[int, int, int]  # mode, count, open until


class Passage:
    """What a range of attempts makes of any state a breaker may come in with.

    Where the breaker is made anew within the range, nothing before counts. Otherwise all that the state on entry decides
    is the first attempt at which it falls in with a state that does not remember it: closed after a success, half-open
    without a probe at the first attempt behind the open time, or open from a failure of the range on. From there the rest
    is computed once, from the last attempt to the first. The entry is described by steps: for a closed breaker by the
    counts that trip in the leading failures, for an open one by the attempts its time may end before, as long as they
    lead to different ends.
    """

    def __init__(self, rows: list[tuple]):
        self.now = [r[0] for r in rows]
        self.rows, self.n = rows, len(rows)
        self._closed: dict[int, State] = {}
        self._half: list[State] = [(HALF_OPEN, 0, 0)] * (self.n + 1)
        # Where the run of failures or successes that attempt i is in ends (exclusive), and the next fresh breaker.
        self.run_end, self.fresh = [self.n] * (self.n + 1), [self.n] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            same = i + 1 < self.n and rows[i + 1][1] == rows[i][1] and not rows[i + 1][5]
            self.run_end[i] = self.run_end[i + 1] if same else i + 1
            self.fresh[i] = i if rows[i][5] else self.fresh[i + 1]
        for i in range(self.n - 1, -1, -1):
            self._half[i] = self._from_half(i, 0)

    def _opened(self, i: int) -> State:
        """The end if attempt i opens the breaker."""
        until = self.now[i] + self.rows[i][4]
        j = bisect.bisect_right(self.now, until)
        if self.fresh[i + 1] < min(j, self.n):
            return self.closed(self.fresh[i + 1])
        return (OPEN, 0, until) if j >= self.n else self._half[j]

    def _from_half(self, i: int, count: int) -> State:
        """The end of a half-open breaker with so many probes, before attempt i."""
        if i == self.n:
            return HALF_OPEN, count, 0
        if self.rows[i][5]:
            return self.closed(i)
        if self.rows[i][1]:
            return self._opened(i)
        end, needed = self.run_end[i], self.rows[i][3] - count
        if end - i >= needed:
            return self.closed(i + max(needed, 1))
        if end == self.n:
            return HALF_OPEN, count + end - i, 0
        return self.closed(end) if self.rows[end][5] else self._opened(end)

    def closed(self, i: int) -> State:
        """The end of a closed breaker without failures, before attempt i."""
        chain = []
        while i not in self._closed:
            if i == self.n:
                self._closed[i] = (CLOSED, 0, 0)
                break
            end = self.run_end[i]
            if not self.rows[i][1]:
                chain.append(i)
                i = end
                continue
            trip = next((k for k in range(i, end) if k - i + 1 >= self.rows[k][2]), None)
            if trip is not None:
                self._closed[i] = self._opened(trip)
                break
            if end == self.n:
                self._closed[i] = (CLOSED, end - i, 0)
                break
            chain.append(i)  # a success or a new breaker follows
            i = end
        for k in chain:
            self._closed[k] = self._closed[i]
        return self._closed[i]

    def summary(self) -> dict:
        """`always`: the end whatever comes in, else steps (least count or open time, end) by mode; see `after`."""
        if self.fresh[0] < self.n:
            first = self.fresh[0]
            always = self.closed(first)
            return {"n": self.n, "always": always, "closed": [], "closed_rest": always, "half_run": 0, "half_done": always, "half_failed": always, "open": []}
        lead = self.run_end[0]
        fails = self.rows[0][1]
        steps, least = [], None
        for k in range(lead if fails else 0):
            needed = self.rows[k][2] - k - 1  # a count on entry of so many failures trips here
            if least is None or needed < least:
                least = needed
                steps.append((max(needed, 0), self._opened(k)))
                if needed <= 0:
                    break
        # Without a trip: failures are added up where nothing but failures comes, else a success forgets them.
        rest = None if fails and lead == self.n else self.closed(lead if fails else 0)
        run = 0 if fails else lead
        ends = []  # last attempts of the steps
        for j in range(self.n):  # an open breaker whose time ends before attempt j
            if ends and ends[-1][1] == self._half[j]:
                ends.pop()
            ends.append((self.now[j], self._half[j]))
        return {
            "n": self.n, "always": None, "closed": steps, "closed_rest": rest, "half_run": run, "half_done": self.closed(run) if run else None,
            "half_failed": self._opened(run) if run < self.n else None, "open": ends, "last": self.now[-1], "probes": self.rows[0][3],
        }


def after(state: State, s: dict) -> State:
    """The state behind a range from the state before it and the range's summary."""
    mode, count, until = state
    if s["always"]:
        return s["always"]
    if mode == CLOSED:
        for needed, end in s["closed"]:
            if count >= needed:
                return end
        return s["closed_rest"] or (CLOSED, count + s["n"], 0)
    if mode == HALF_OPEN:
        if s["half_run"] and count + s["half_run"] >= s["probes"]:
            return s["half_done"]
        return s["half_failed"] or (HALF_OPEN, count + s["n"], 0)
    if until >= s["last"]:
        return state
    # The first attempt behind the open time is in the first step that ends behind it.
    return next(end for last, end in s["open"] if until < last)


def breaker_replay(
    attempts: DataFrame,
    failures: int = v.BREAKER_DEFAULTS["failure_threshold"],
    probes: int = v.BREAKER_DEFAULTS["success_threshold"],
    open_seconds: int = v.BREAKER_DEFAULTS["open_duration_seconds"],
    changes: DataFrame | None = None,
) -> DataFrame:
    """Replay attempts through one breaker per endpoint.

    Adds ``called`` (false: rejected without a call) and ``breaker_state`` after
    the attempt. With ``changes`` of the settings, each attempt meets those in force:
    the failure threshold is looked up anew at every failure; a breaker is made anew
    before the first attempt that finds another success threshold or open duration.

    An ordinary endpoint is one sorted stream. A hot endpoint is cut into time ranges.
    All ranges are summed up at the same time for every state a breaker may come in
    with, one small fold per endpoint hands the states on, and all ranges are replayed
    at the same time: a fixed number of jobs, and the sequential result.
    """
    given = {"failure_threshold": failures, "success_threshold": probes, "open_duration_seconds": open_seconds}
    if changes is None:
        rows = attempts.withColumns({name: F.lit(n).cast("bigint") for name, n in given.items()})
    else:
        rows = with_settings(attempts, changes)
    rows = delivery_outcome(rows).withColumns({"_micros": _micros(), "_open": F.col("open_duration_seconds") * 1_000_000})
    order = ["_micros", "attempt_id"]
    shape = F.struct("success_threshold", "open_duration_seconds")
    added = [T.StructField("called", T.BooleanType()), T.StructField("breaker_state", T.StringType())]
    kept = [*attempts.columns, "breaker_failure", "outcome", "called", "breaker_state"]

    def replayed(df: DataFrame, place: list[str]) -> DataFrame:
        """Every place a sorted stream through one task, from the state in ``_mode, _count, _until`` on; a task holds one
        Arrow batch, however many attempts an endpoint has."""
        entry = ["_mode", "_count", "_until"]
        names = [*attempts.columns, "breaker_failure", "outcome"]
        schema = T.StructType([*df.select(*names).schema.fields, *added])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, breaker = None, None
            for frame in frames:
                called, states = [], []
                keys, begun = frame[place].itertuples(index=False, name=None), frame[entry].itertuples(index=False, name=None)
                for key, state, seen in zip(keys, begun, frame[_SEEN].itertuples(index=False, name=None), strict=True):
                    now, failed, limit, needed, open_micros, fresh = seen
                    if key != at:
                        at, breaker = key, Breaker(*map(int, state))
                    if fresh:
                        breaker = Breaker()
                    called.append(breaker.call(int(now), bool(failed), int(limit), int(needed), int(open_micros)))
                    states.append(_NAMES[breaker.mode])
                yield frame[names].assign(called=called, breaker_state=states)

        rows = df.select(*dict.fromkeys([*names, *place, *order, *entry, *_SEEN]))
        return rows.repartition(*place).sortWithinPartitions(*place, *order).mapInPandas(run, schema)

    def ordinary(df: DataFrame) -> DataFrame:
        before = Window.partitionBy(*ENDPOINT).orderBy(*order)
        df = df.withColumn("_fresh", F.coalesce(F.lag(shape).over(before) != shape, F.lit(False)))
        closed = {name: F.lit(0).cast("bigint") for name in ("_mode", "_count", "_until")}
        return replayed(df.withColumns(closed), ENDPOINT).select(*kept)

    def hot(df: DataFrame) -> DataFrame:
        chunk = [*ENDPOINT, "_chunk"]
        df = skew.running(skew.chunked(df, ENDPOINT, "_micros"), ENDPOINT, F.col("_chunk"), order, {"_before": ("last", shape)})
        df = skew.cut(df.withColumn("_fresh", F.coalesce(F.col("_before") != shape, F.lit(False))).drop("_before"))

        def passage(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable")
            seen = [tuple(map(int, r)) for r in pdf[_SEEN].itertuples(index=False, name=None)]
            return pdf.iloc[[0]][chunk].assign(summary=json.dumps(Passage(seen).summary()))

        def chained(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, state, entries = pdf.sort_values("_chunk"), (CLOSED, 0, 0), []
            for text in pdf["summary"]:
                entries.append(state)
                state = after(state, json.loads(text))
            return pdf[chunk].assign(_mode=[e[0] for e in entries], _count=[e[1] for e in entries], _until=[e[2] for e in entries])

        keys = f"endpoint {df.schema['endpoint'].dataType.simpleString()}, _chunk bigint"
        sums = df.select(*chunk, "attempt_id", *_SEEN).groupBy(*chunk).applyInPandas(passage, f"{keys}, summary string")
        # One row per range of an endpoint.
        entries = skew.cut(sums.groupBy(*ENDPOINT).applyInPandas(chained, f"{keys}, _mode bigint, _count bigint, _until bigint"))
        return replayed(df.join(entries, chunk), chunk).select(*kept)

    return skew.both(rows, ENDPOINT, skew.hot_keys(attempts, ENDPOINT), ordinary, hot)
