"""Verdicts per minute as a stream: a second stateful operator counts behind the gate.

A minute is never closed: a verdict that comes late changes its count, and the changed count is written again. A minute of
one verdict is spread over SALTS counters, so that a busy one is not counted by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SALTS = 16
_COUNT = "minute timestamp, verdict string, salt int, n bigint"
_OUT = Row("minute", "verdict", "salt", "n")


class Counter(StatefulProcessor):
    """Adds a micro-batch's rows to the count of its key, and says the new count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._n = handle.getValueState("n", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        before = self._n.get()
        n = (before[0] if before else 0) + sum(1 for _ in rows)
        self._n.update((n,))
        yield _OUT(*key, n)


def verdict_counts(gated: DataFrame) -> DataFrame:
    """Changed counts of a gate stream (``gate.gate_stream``), one row per counter and micro-batch."""
    verdicts = gated.filter("kind = 'verdict'").select(
        F.date_trunc("minute", "ts").alias("minute"), "verdict", F.pmod("pos", F.lit(SALTS)).cast("int").alias("salt")
    )
    return verdicts.groupBy("minute", "verdict", "salt").transformWithState(
        statefulProcessor=Counter(), outputStructType=_COUNT, outputMode="Append", timeMode="None"
    )


def per_minute(written: DataFrame) -> DataFrame:
    """The counts as of now, from all that was written (with the number of the ``batch``)."""
    latest = written.groupBy("minute", "verdict", "salt").agg(F.max_by("n", "batch").alias("n"))
    return latest.groupBy(F.col("minute").cast("timestamp_ntz").alias("minute"), "verdict").agg(F.sum("n").alias("n"))
