"""What a stream holds, read from its checkpoint: waiting rooms and counters, without the stream running.

The state is Spark's own, read by its state data source one variable of the gate at a time; as of the last
committed micro-batch, or of an earlier one that the checkpoint still keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.streaming import sinks


def variable(spark: SparkSession, checkpoint: str, name: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """The rows of one state variable of an operator of the query."""
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name)
    if batch is not None:
        reader = reader.option("batchId", batch)
    with sinks.rocksdb(spark):
        return reader.load(checkpoint)


def waiting(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """plan_id, seq_id, payload, pos, ts of everything that waits: in the plan's value, or the head of each step and the
    twins behind it."""
    inside = variable(spark, checkpoint, "plan", batch=batch)
    held = [inside.select("user_map_key.plan_id", F.explode("user_map_value.room").alias("_r")).select("plan_id", "_r.*")]
    for name in ("heads", "twins"):
        held.append(variable(spark, checkpoint, name, batch=batch).select("user_map_key.plan_id", "user_map_value.*"))
    kept = [rows.select("plan_id", "seq_id", "payload", "pos", "ts", "event_id", "order_id") for rows in held]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def plans(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """plan_id, counter, abort_until, last_add (microseconds) of every plan the stream has seen."""
    rows = variable(spark, checkpoint, "plan", batch=batch)
    return rows.select("user_map_key.plan_id", *[f"user_map_value.{name}" for name in ("counter", "abort_until", "last_add")])


def seq_counters(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    return plans(spark, checkpoint, batch).select("plan_id", F.col("counter").cast("int").alias("counter"))


def buffer_snapshot(spark: SparkSession, checkpoint: str, as_of: Column, ttl_seconds: int, batch: int | None = None) -> DataFrame:
    """Live buffers: size, step range and seconds left to live at ``as_of``."""
    sizes = waiting(spark, checkpoint, batch).groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("seq_id").cast("int").alias("min_seq"),
        F.max("seq_id").cast("int").alias("max_seq"),
    )
    added = F.timestamp_micros("last_add").cast("timestamp_ntz")
    rooms = sizes.join(plans(spark, checkpoint, batch).select("plan_id", added.alias("last_add")), "plan_id")
    left = F.lit(ttl_seconds) - F.timestamp_diff("SECOND", F.col("last_add"), as_of)
    return rooms.withColumn("ttl_left", left)
