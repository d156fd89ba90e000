"""Idempotent stream sinks and the tables folded from them."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators import orders, skew
from seqloom.operators.lifetimes import timeout_letters  # noqa: F401  (of a stream's output, too)
from seqloom.streaming import gate

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Without a count of all keys, which costs a read per write.
STORE = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def write_batches(out: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Write each micro-batch under its own id: a retried batch overwrites itself.

    State, offsets and output then agree on every restart.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # An overwrite of the batch's own folder, split by kind.
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")

    writer = out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")
    return writer.start()


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    path = f"{skew.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    skew.delete_at_end(spark, path)
    return path


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_to_end(out: DataFrame) -> DataFrame:
    """Run a streaming frame to the end of its input and read back what it wrote."""
    spark = out.sparkSession
    folder = scratch(spark)
    write_batches(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out")


def run_gate(log: DataFrame, lifetimes=gate.STANDARD, delay: str = "10 minutes") -> DataFrame:
    """Run a streaming log through the gate to its end."""
    with rocksdb(log.sparkSession):
        return run_to_end(gate.gate_stream(log, lifetimes, delay))


def gated_rows(written: DataFrame) -> DataFrame:
    """Stream output in the shape of the batch gate, for the order fold."""
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return (
        written.filter(F.col("kind").isin("applied", "abort"))
        .withColumn("applied", F.col("kind") == "applied")
        .withColumns({"ts": ntz("ts"), "applied_ts": ntz("applied_ts")})
    )


def order_tables(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order rows, outbox) folded from everything written so far."""
    rows = gated_rows(written)
    guarded = orders.order_guard(rows, orders.hot_orders(rows))
    return orders.order_state(guarded), orders.outbox_rows(guarded)
