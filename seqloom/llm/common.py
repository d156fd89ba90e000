"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
GAP = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def bind(value: Column, body) -> Column:
    """body(value) with `value` evaluated once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the session's JVM ends.

    Where the setting is missing, a local session gets a temporary folder; a cluster must name a shared one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again, so that later plans start from files all executors see."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(f"{folder}/t")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/t")
    out.staged_folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bound the bytes one Arrow batch hands to Python: whole texts can be long. A lower setting is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= size:
        spark.conf.set(key, str(size))


def bounded(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """`df` to be broadcast if it has at most so many rows, else as it is; it should be a written table."""
    return df if df.limit(rows + 1).count() > rows else F.broadcast(df)
