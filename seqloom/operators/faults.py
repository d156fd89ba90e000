"""Fault scenarios as log transforms: late steps, resends, zombies, shuffles, replicas.

Each returns a log with new positions; nothing is sampled away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v

LATE = 2**62  # positions in a log stay below this


def late_step(log: DataFrame, seq: int = 2) -> DataFrame:
    """Hold one step of every plan back until everything else has arrived."""
    late = F.col("seq_id") == seq
    return log.withColumn("pos", F.when(late, F.col("pos") + LATE).otherwise(F.col("pos")))


def resend_all(log: DataFrame) -> DataFrame:
    """Send the whole log again behind itself."""
    return log.unionByName(log.withColumn("pos", F.col("pos") + LATE))


def abort_after(log: DataFrame, seq: int = 1) -> DataFrame:
    """Put a tombstone right behind one step; later steps become zombies."""
    empty_string = F.lit(None).cast("string")
    tombstones = log.filter(F.col("seq_id") == seq).withColumns(
        {
            "pos": F.col("pos") * 2 + 1,
            "event_id": s.stable_uuid(F.lit("abort"), F.col("event_id")),
            "event_type": F.lit(v.ABORT),
            "payload": s.stable_uuid(F.lit("abort"), F.col("event_id")),
            "seq_id": F.lit(None).cast("int"),
            "user_id": empty_string,
            "total_amount": F.lit(None).cast("double"),
        }
    )
    return log.withColumn("pos", F.col("pos") * 2).unionByName(tombstones)


def shuffled(log: DataFrame, seed: int = 0) -> DataFrame:
    """Arrival order by a seeded hash: the same on every run."""
    mixed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "event_id", "pos"), 2)
    return log.withColumn("pos", mixed)


def replica_of(event_id: Column) -> Column:
    """Route an event to one of two replicas, half and half."""
    return F.when(F.substring(F.md5(event_id), 1, 1) < "8", F.lit("alpha")).otherwise(
        F.lit("beta")
    )


def inject_faults(log: DataFrame) -> DataFrame:
    """Every scenario of one log, tagged."""
    scenarios = {
        "late_step": late_step(log),
        "resend_all": resend_all(log),
        "abort_after": abort_after(log),
        "shuffled": shuffled(log),
    }
    tagged = [df.withColumn("scenario", F.lit(name)) for name, df in scenarios.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
