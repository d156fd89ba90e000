"""Event logs and order inputs derived from the benchmark tables.

Every log has ``plan_id, order_id, seq_id, event_id, event_type, ts, pos,
payload, user_id, total_amount``. ``pos`` is the arrival order: total within a
plan and within an order, and never compared beyond. ``payload`` identifies the
message, as the text of the message would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The same table as a file stream, a bounded number of files per micro-batch."""
    files = spark.readStream.schema(read(spark, sf_dir, table).schema)
    files = files.option("maxFilesPerTrigger", 1000).option("pathGlobFilter", f"{table}.parquet")
    return files.parquet(sf_dir)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to as many tasks as the session asks for (``spark.seqloom.inputPartitions``), if it asks.

    For a single machine whose input is one file with one row group, which no
    split size cuts; a cluster leaves the setting alone and reads in place.
    """
    asked = df.sparkSession.conf.get("spark.seqloom.inputPartitions", None)
    return df.repartition(int(asked)) if asked else df


def _type_of_seq(seq: Column) -> Column:
    out = F.concat(F.lit("Unknown"), seq.cast("string"))
    for number, name in enumerate(v.SEQUENCED_TYPES, start=1):
        out = F.when(seq == number, F.lit(name)).otherwise(out)
    return out


def log_lineitem(spark: SparkSession, sf_dir: str, split_plans: bool = False) -> DataFrame:
    """Order lines as events: gaps, repeats, late arrivals and unknown types 6 and 7.

    With ``split_plans`` each return flag is a plan of its own, so that up to
    three plans work on one order.
    """
    li = read(spark, sf_dir, "lineitem")
    seq = F.col("l_linenumber")
    plan = F.concat(F.lit("plan_"), F.col("l_orderkey").cast("string"))
    if split_plans:
        plan = F.concat(plan, F.lit("_"), F.col("l_returnflag"))
    # Ship day, then part, then line: exact as long as part keys stay below 2**45.
    pos = (
        F.shiftleft(F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint"), 48)
        + F.col("l_partkey") * 8
        + seq
    )
    event_id = s.stable_uuid(
        F.lit("line"), F.col("l_orderkey"), F.col("l_shipdate").cast("date"), F.col("l_partkey"), seq
    )
    return li.select(
        plan.alias("plan_id"),
        s.uuid_shape(F.md5(F.col("l_orderkey").cast("string"))).alias("order_id"),
        seq.alias("seq_id"),
        event_id.alias("event_id"),
        _type_of_seq(seq).alias("event_type"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        pos.alias("pos"),
        event_id.alias("payload"),
        F.when(
            F.col("l_returnflag") == "A",
            F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")),
        ).alias("user_id"),
        F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice")).alias("total_amount"),
    )


def log_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Click stream as events: one plan per user and day, errors abort it."""
    ev = read_stream(spark, sf_dir, "events") if stream else read(spark, sf_dir, "events")
    kind = F.col("event_type")
    seq = F.lit(None).cast("int")
    # --- fixed values: step number of each click-stream type ---
    for name, number in {"signup": 1, "view": 2, "click": 3, "purchase": 4}.items():
        seq = F.when(kind == name, F.lit(number)).otherwise(seq)
    day = F.date_format("ts", "yyyyMMdd")
    owner = F.concat(F.col("user_id").cast("string"), F.lit("_"), day)
    event_id = s.uuid_shape(F.md5(F.concat(F.lit("ev"), F.col("event_id").cast("string"))))
    return ev.select(
        F.concat(F.lit("plan_"), owner).alias("plan_id"),
        s.uuid_shape(F.md5(owner)).alias("order_id"),
        seq.alias("seq_id"),
        event_id.alias("event_id"),
        F.when(kind == "error", F.lit(v.ABORT)).otherwise(_type_of_seq(seq)).alias("event_type"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").cast("bigint").alias("pos"),
        event_id.alias("payload"),
        F.when(
            kind == "signup", F.concat(F.lit("user_"), F.col("user_id").cast("string"))
        ).alias("user_id"),
        F.when(kind.isin("signup", "click"), F.col("value")).alias("total_amount"),
    )


def log_sessions(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Click stream as events of one plan per user over the whole month, hours apart: what waits times out, and
    tombstones (some of the errors) lapse long before the plan ends."""
    ev = read_stream(spark, sf_dir, "events") if stream else read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    seq = (1 + F.floor(F.dayofmonth("ts") / 6) + k % 3).cast("int")
    tombstone = (F.col("event_type") == "error") & (k < 25)
    owner = F.col("user_id").cast("string")
    event_id = s.uuid_shape(F.md5(F.concat(F.lit("session"), F.col("event_id").cast("string"))))
    return ev.select(
        F.concat(F.lit("plan_user_"), owner).alias("plan_id"),
        s.uuid_shape(F.md5(F.concat(F.lit("session"), owner))).alias("order_id"),
        F.when(~tombstone, seq).alias("seq_id"),
        event_id.alias("event_id"),
        F.when(tombstone, F.lit(v.ABORT)).otherwise(_type_of_seq(seq)).alias("event_type"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").cast("bigint").alias("pos"),
        event_id.alias("payload"),
        F.lit(None).cast("string").alias("user_id"),
        F.lit(None).cast("double").alias("total_amount"),
    )


ITEM = "struct<product_id:string,quantity:int,unit_price:double>"
REQUEST = (
    f"order_id string, user_id string, items array<{ITEM}>, total_amount double, currency string"
)


def order_request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON order request per order row: ``request_key, created, value``.

    Some miss their id, currency or total, some have no items, some totals do not
    match, some are no JSON.
    """
    orders = spread(read(spark, sf_dir, "orders"))
    price, priority, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")

    def item(name: str, quantity: int, unit_price: Column) -> Column:
        return F.struct(
            F.concat(F.lit(name), F.col("o_custkey").cast("string")).alias("product_id"),
            F.lit(quantity).alias("quantity"),
            unit_price.alias("unit_price"),
        )

    items = (
        F.when(priority == "5-LOW", F.expr(f"cast(array() as array<{ITEM}>)"))
        .when(priority == "4-NOT SPECIFIED", F.array(item("whole_", 1, price)))
        .otherwise(F.array(item("main_", 1, price - 100.0), item("extra_", 2, F.lit(50.0))))
    )
    total = (
        F.when((status == "P") & (priority == "1-URGENT"), F.lit(0.0))
        .when(status == "P", price + 0.02)
        .otherwise(price)
    )
    total = F.when(F.col("o_orderkey") % 89 != 0, total)
    broken = F.col("o_orderkey") % 97 == 0
    request = F.struct(
        F.when(status != "F", s.uuid_shape(F.md5(F.col("o_orderkey").cast("string")))).alias("order_id"),
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("user_id"),
        items.alias("items"),
        total.alias("total_amount"),
        F.when(priority != "2-HIGH", F.lit("USD")).alias("currency"),
    )
    return orders.select(
        F.col("o_orderkey").alias("request_key"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created"),
        F.when(broken, F.lit("{broken")).otherwise(F.to_json(request)).alias("value"),
    )


def orders_json(texts: DataFrame) -> DataFrame:
    """Order requests from JSON text; ``unreadable`` marks text that is no JSON object of these fields."""
    # As a generator, so that later filters do not parse the text once more.
    options = {"columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json("value", f"{REQUEST}, _bad string", options)
    once = F.explode(F.array(parsed)).alias("_r")
    fields = [f"_r.{part.split()[0]}" for part in ("order_id", "user_id", "items", "total_amount", "currency")]
    unreadable = (F.col("_r").isNull() | F.col("_r._bad").isNotNull() | F.col("value").isNull()).alias("unreadable")
    return texts.select("request_key", "created", "value", once).select("request_key", "created", *fields, unreadable)


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without items, for the rules over a table of lines."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_key"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("o_totalprice").alias("total_amount"),
        F.lit(None).cast("string").alias("currency"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"),
    )


def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click stream as delivery attempts over sixteen endpoints."""
    ev = read(spark, sf_dir, "events")
    code = F.lit(500)
    # --- fixed values: answer of each click-stream type; errors answer 500 ---
    for name, answer in {"signup": 200, "view": 204, "click": 503, "purchase": 404}.items():
        code = F.when(F.col("event_type") == name, F.lit(answer)).otherwise(code)
    lost = F.col("value") > 150
    return ev.select(
        F.concat(F.lit("hook_"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 1)).alias(
            "endpoint"
        ),
        F.col("event_id").alias("attempt_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(~lost, code).alias("status_code"),
        lost.alias("transport_error"),
    )


def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click stream as a change log of the breaker settings; errors are unreadable."""
    ev = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    # Durations may carry a sign and pass 32 bits.
    number = (
        F.when((F.col("event_type") == "click") & (k.cast("int") % 7 == 0), F.concat(F.lit("+"), k))
        .when((F.col("event_type") == "purchase") & (k.cast("int") % 11 == 0), F.concat(k, F.lit("00000000")))
        .otherwise(k)
    )
    key = F.lit("success_threshold")
    # --- fixed values: setting each click-stream type changes ---
    names = {
        "signup": "failure_threshold",
        "click": "timeout_seconds",
        "purchase": "open_duration_seconds",
    }
    for name, setting in names.items():
        key = F.when(F.col("event_type") == name, F.lit(setting)).otherwise(key)
    return ev.select(
        key.alias("key"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("x"), number))
        .otherwise(number)
        .alias("value"),
        F.col("event_id").alias("version"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


def breaker_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slower change log of the breaker settings: the click stream's smallest values, some unreadable."""
    ev = read(spark, sf_dir, "events").filter(F.col("value") < 2.5)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    # --- fixed values: setting each click-stream type changes, and to what ---
    key, value = F.lit("timeout_seconds"), F.lit("x")
    for name, setting, number in (
        ("signup", "failure_threshold", 1 + k % 4),
        ("view", "success_threshold", 1 + k % 3),
        ("purchase", "open_duration_seconds", 600 + 300 * (k % 7)),
    ):
        key = F.when(kind == name, F.lit(setting)).otherwise(key)
        value = F.when(kind == name, number.cast("string")).otherwise(value)
    return ev.select(key.alias("key"), value.alias("value"), F.col("event_id").alias("version"), F.col("ts").cast("timestamp_ntz").alias("ts"))


def order_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempts with the order whose outbox they work on: that of the user's day."""
    owner = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"),
        s.uuid_shape(F.md5(F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd")))).alias("order_id"),
    )
    return delivery_attempts(spark, sf_dir).join(owner, "attempt_id")
