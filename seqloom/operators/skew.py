"""Tools that keep one hot key from becoming one hot task.

* ``hot_keys`` finds the keys too large for one task; ``both`` gives ordinary
  keys to windows and hot keys to a form that aggregates first. Without hot
  keys the plan is the ordinary one alone.
* ``spread_lookup`` joins rows to one fact row per key with the copies of a
  hot key spread over many tasks.
* ``running`` is an exclusive running aggregate in two levels: within bounded
  buckets, and over one total row per bucket.

All three give the same rows as the plain form; only the layout differs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Most rows of one key that a single task is given.
HOT_ROWS_CONF = "spark.seqloom.hotRows"
HOT_ROWS = 1_000_000
# Hot keys handled apart. A key outside this list has at most 1/HOT_KEYS of
# all rows, whatever the data; the list itself is small enough to broadcast.
HOT_KEYS = 100_000
# Hashes that rows are counted by before keys are.
HOT_BUCKETS = 65_536
# Steps per bucket of a running aggregate; only buckets that hold steps exist.
SEQ_BUCKET = 65_536
# Parts a range is cut into at a time, and the most rounds of it (64**9 parts are more than rows can fill).
SPLITS = 64
MAX_ROUNDS = 9


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A local session that
    names none gets one of its own; a cluster must name it, as executors cannot
    see each other's folders."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="seqloom-")
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system remove ``path`` when the session's JVM ends."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    For logs that are costly to derive (parsed text) and read several times:
    later reads take only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    delete_at_end(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with too many rows for one task, or None when there are none.

    A key is at most as frequent as its hash, so hashes are counted first: HOT_BUCKETS
    of them, which the map side brings down to so many rows a task whatever the number
    of keys. Only keys of hashes with too many rows are counted one by one. What comes
    back is bounded whatever the data: at most HOT_BUCKETS hashes and HOT_KEYS keys.
    """
    limit = hot_rows(df)
    hashed = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(HOT_BUCKETS)).cast("int").alias("_bucket"))
    counted = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    crowded = counted.filter(F.col("_rows") > limit).select("_bucket").collect()
    if not crowded:
        return None
    crowded = F.broadcast(df.sparkSession.createDataFrame(crowded, "_bucket int"))
    found = (
        hashed.join(crowded, "_bucket", "left_semi")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
        .orderBy(F.desc("_rows"), *keys)
        .limit(HOT_KEYS)
        .select(*keys)
    )
    listed = found.collect()
    return df.sparkSession.createDataFrame(listed, found.schema) if listed else None


def lanes(
    df: DataFrame, keys: Sequence[str], hot: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary rows, rows of hot keys or None); together they are exactly ``df``."""
    if hot is None:
        return df, None
    hot = F.broadcast(hot)
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def both(
    df: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None,
    on_ordinary: Callable[[DataFrame], DataFrame],
    on_hot: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Apply one operator in its ordinary form, and in its hot form where needed."""
    ordinary, hot_part = lanes(df, keys, hot)
    ordinary = on_ordinary(ordinary)
    if hot_part is None:
        return ordinary
    return ordinary.unionByName(on_hot(hot_part).select(*ordinary.columns))


def spread_lookup(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str, by: str
) -> DataFrame:
    """Left join to ``facts`` (one row per key, ``count`` = rows it will meet).

    A key with more than ``hot_rows`` matches is joined through several copies
    of its fact row; ``by`` is a column that spreads the rows over the copies.
    """
    keys = list(keys)
    limit = hot_rows(rows)
    copies = (
        facts.filter(F.col(count) > limit)
        .orderBy(F.desc(count), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.ceil(F.col(count) / limit).cast("int").alias("_copies"))
    )
    copies = F.broadcast(copies)
    salted = rows.join(copies, keys, "left").withColumn(
        "_salt",
        F.pmod(F.xxhash64(by), F.coalesce("_copies", F.lit(1))).cast("int"),
    )
    spread = (
        facts.join(copies, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
        .drop("_copies", count)
    )
    return salted.drop("_copies").join(spread, [*keys, "_salt"], "left").drop("_salt")


def chunked(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Add ``_chunk``: ranges of ``column`` with at most a quarter of ``hot_rows`` rows each, in order.

    For the rows of hot keys only. A range that is too large is cut at its own
    quantiles, SPLITS at a time, until none is; only rows with one and the same
    value stay together. Each round broadcasts a row per range that is too
    large, of which there are at most (rows / limit).
    """
    keys = list(keys)
    limit = max(1, hot_rows(df) // 4)
    cuts = [i / SPLITS for i in range(1, SPLITS)]
    out = df.withColumn("_chunk", F.lit(0).cast("bigint"))
    for _ in range(MAX_ROUNDS):
        large = (
            out.groupBy(*keys, "_chunk")
            .agg(
                F.count(F.lit(1)).alias("_rows"),
                F.array_distinct(F.percentile_approx(column, cuts, 10_000)).alias("_cuts"),
                (F.min(column) < F.max(column)).alias("_apart"),
            )
            .filter((F.col("_rows") > limit) & F.col("_apart"))
            .select(*keys, "_chunk", "_cuts")
        )
        large = cut(large)
        if large.isEmpty():
            break
        place = F.size(F.filter("_cuts", lambda c: c < F.col(column)))
        joined = out.join(F.broadcast(large), [*keys, "_chunk"], "left")
        out = joined.withColumn("_chunk", F.col("_chunk") * SPLITS + F.coalesce(place, F.lit(0))).drop("_cuts")
    return out


def ranged(df: DataFrame, order: Sequence[str], name: str = "_range") -> DataFrame:
    """``df`` written in ranges of ``order`` with about a quarter of ``hot_rows`` rows each, numbered in order by ``name``.

    For scans without a key: the ranges are Spark's own, cut at sampled values of the whole order, so rows of one
    instant are split as long as the order tells them apart.
    """
    limit = max(1, hot_rows(df) // 4)
    parts = -(-max(1, df.count()) // limit)
    dealt = df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id().cast("bigint"))
    return stage(dealt)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    descending: bool = False,
) -> DataFrame:
    """Add exclusive running aggregates: ``{name: (kind, value)}``.

    ``kind`` is sum, min, max, first or last; nulls are skipped. ``bucket`` must
    not decrease along ``order``. The rows of one (key, bucket) are windowed in
    one task; across buckets only one total row each is.
    """
    keys = list(keys)
    order_cols = [F.desc(c) if descending else F.asc(c) for c in order]
    bucket_order = F.desc("_bucket") if descending else F.asc("_bucket")
    ordering = F.struct(*order)
    values = {f"_v_{name}": value for name, (_, value) in specs.items()}
    df = df.withColumns({"_bucket": bucket, **values})

    def total(kind: str, column: str) -> Column:
        known = F.when(F.col(column).isNotNull(), ordering)
        if kind in ("first", "last"):
            late = (kind == "last") != descending
            return F.max_by(column, known) if late else F.min_by(column, known)
        return getattr(F, kind)(column)

    def over(kind: str, column: str, window) -> Column:
        if kind in ("first", "last"):
            return getattr(F, kind)(column, ignorenulls=True).over(window)
        return getattr(F, kind)(column).over(window)

    before = (Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket_order).rowsBetween(*before)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order_cols).rowsBetween(*before)
    totals = df.groupBy(*keys, "_bucket").agg(
        *[total(kind, f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in specs.items()]
    )
    carried = totals.select(
        *keys,
        "_bucket",
        *[over(kind, f"_t_{n}", outer).alias(f"_c_{n}") for n, (kind, _) in specs.items()],
    )
    df = df.join(carried, [*keys, "_bucket"], "left")
    added = {}
    for name, (kind, _) in specs.items():
        carry, here = F.col(f"_c_{name}"), over(kind, f"_v_{name}", inner)
        if kind == "sum":
            added[name] = F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif kind == "max":
            added[name] = F.greatest(carry, here)
        elif kind == "min":
            added[name] = F.least(carry, here)
        elif kind == "last":
            added[name] = F.coalesce(here, carry)
        else:
            added[name] = F.coalesce(carry, here)
    drops = ["_bucket", *values, *[f"_c_{n}" for n in specs]]
    return df.withColumns(added).drop(*drops)
