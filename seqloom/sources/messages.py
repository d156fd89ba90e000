"""Messages derived from the click stream, many of them broken on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v
from seqloom.sources.tables import read, read_stream, spread


def _data_text() -> Column:
    """Payload text per event type; ranges of ``k`` pick the variant."""
    k, amount = F.col("k"), F.col("amount")
    stamp = F.lit("2024-01-06T10:00:00Z")
    user = F.when(k.between(25, 29), F.lit("7")).when(
        k.between(35, 39), F.concat(F.lit('"user_'), F.repeat(F.lit("x"), 60), F.lit('"'))
    ).otherwise(
        F.concat(F.lit('"user_'), F.col("user_id"), F.lit('"'))
    )
    items = F.when(k.between(10, 14), F.lit("[]")).otherwise(
        F.concat(
            F.lit('[{"product_id":"p'), k, F.lit('","quantity":'), k, F.lit(',"unit_price":'), amount, F.lit("}]")
        )
    )
    total = (
        F.when(k.between(20, 24), F.concat(F.lit('"'), amount, F.lit('"')))
        .when(k.between(30, 34), F.lit("123456789012.5"))
        .otherwise(amount)
    )
    note = F.when(k.between(15, 19), F.lit(',"note":"x"')).otherwise(F.lit(""))
    declared = k < 50
    created = F.concat(
        F.lit('{"user_id":'), user, F.lit(',"items":'), items, F.lit(',"total_amount":'), total,
        F.lit(',"currency":"BRL"'), note, F.lit("}"),
    )
    inventory = F.when(
        declared,
        F.concat(
            F.lit('{"validated":true,"items_status":[{"product_id":"p'), k,
            F.lit('","available":true,"reserved_quantity":'), k, F.lit("}]}"),
        ),
    ).otherwise(
        F.concat(F.lit('{"warehouse_id":"wh_1","all_items_available":true,"reserved_until":"'), stamp, F.lit('"}'))
    )
    payment = F.when(
        declared,
        F.concat(
            F.lit('{"payment_id":"'), F.col("event_uuid"),
            F.lit('","method":"pix","status":"approved","amount":'), amount, F.lit(',"currency":"BRL"}'),
        ),
    ).otherwise(
        F.concat(F.lit('{"payment_id":"pay_1","method":"cash","status":"approved","amount":'), amount, F.lit("}"))
    )
    shipped = F.concat(
        F.lit('{"tracking_code":"TRK1","carrier":"correios","estimated_delivery":"'),
        F.when(k < 20, F.lit("2024-01-06")).when(k < 25, F.lit("2024-13-06")).otherwise(stamp),
        F.lit('"}'),
    )
    completed = F.concat(
        F.lit('{"final_status":"'),
        F.when(k < 75, F.lit("delivered")).otherwise(F.lit("lost")),
        F.lit('","completed_at":"'), stamp, F.lit('"}'),
    )
    # A tombstone's amount is nobody's business, however large.
    abort = F.when(
        k < 10, F.concat(F.lit('{"reason":"r","abort_code":"timeout","aborted_at_seq":'), k, F.lit(',"total_amount":123456789012.5}'))
    ).when(
        declared, F.concat(F.lit('{"reason":"r","abort_code":"timeout","aborted_at_seq":'), k, F.lit("}"))
    ).otherwise(F.lit('{"reason":"r","abort_code":"whatever"}'))
    kind = F.col("kind")
    return (
        F.when(kind == "OrderCreated", created)
        .when(kind == "InventoryValidated", inventory)
        .when(kind == "PaymentProcessed", payment)
        .when(kind == "OrderShipped", shipped)
        .when(kind == "OrderCompleted", completed)
        .otherwise(abort)
    )


def raw_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Click stream as raw log records. Ranges of ``value`` pick an envelope fault."""
    name, k, value = F.col("event_type"), F.col("k"), F.col("value")
    kind = (
        F.when(name == "signup", F.lit("OrderCreated"))
        .when(name == "view", F.lit("InventoryValidated"))
        .when(name == "click", F.lit("PaymentProcessed"))
        .when((name == "purchase") & (k < 50), F.lit("OrderShipped"))
        .when(name == "purchase", F.lit("OrderCompleted"))
        .otherwise(F.lit(v.ABORT))
    )
    seq = F.lit(None).cast("int")
    for number, known in enumerate(v.SEQUENCED_TYPES, 1):
        seq = F.when(F.col("kind") == known, F.lit(number)).otherwise(seq)
    owner = F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd"))
    events = (
        read_stream(spark, sf_dir, "events") if stream else spread(read(spark, sf_dir, "events"))
    )
    rows = (
        events
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumns(
            {
                "kind": kind,
                "amount": F.col("value").cast("decimal(12,2)").cast("string"),
                "owner": owner,
                "order_uuid": s.uuid_shape(F.md5(owner)),
                "event_uuid": s.uuid_shape(F.md5(F.concat(F.lit("ev"), F.col("event_id").cast("string")))),
            }
        )
        .withColumn("step", seq)
    )
    quoted = lambda label, c: F.concat(F.lit(f'"{label}":"'), c, F.lit('"'))
    step_text = (
        F.when(F.col("step").isNull() | value.between(3, 3.99), F.lit(""))
        .when(value.between(1, 1.99), F.concat(F.lit(',"seq_id":"'), F.col("step"), F.lit('"')))
        .when(value.between(2, 2.99), F.lit(',"seq_id":1.5'))
        .when(value.between(9, 9.99), F.lit(',"seq_id":3000000000'))
        .otherwise(F.concat(F.lit(',"seq_id":'), F.col("step")))
    )
    # What follows a whole message; some of it would end a list that the text were put into.
    behind = F.lit("")
    for low, high, tail in (
        (11, 11.19, "] garbage"), (11.2, 11.39, "]"), (11.4, 11.59, '] ,[{"a":1}'), (11.6, 11.79, '],"'), (11.8, 11.99, ' {"a":1}'), (12, 12.19, ',"x"'),
    ):
        behind = F.when(value.between(low, high), F.lit(tail)).otherwise(behind)
    text = F.concat(
        F.lit("{"),
        # A key that comes twice: the second one counts.
        F.when(value.between(10, 10.99), F.lit('"event_type":"Twice",')).otherwise(F.lit("")),
        quoted("event_id", F.col("event_uuid")),
        F.lit(","),
        quoted("event_type", F.when(value.between(6, 6.99), F.lit("Mystery")).otherwise(F.col("kind"))),
        F.lit(","),
        quoted(
            "plan_id",
            F.when(value.between(4, 4.99), F.concat(F.lit("bad plan "), F.col("owner"))).otherwise(
                F.concat(F.lit("plan_"), F.col("owner"))
            ),
        ),
        step_text,
        F.lit(","),
        quoted("order_id", F.when(value.between(5, 5.99), F.lit("no-uuid")).otherwise(F.col("order_uuid"))),
        F.lit(","),
        quoted(
            "timestamp",
            F.when(value.between(7, 7.99), F.lit("yesterday")).otherwise(F.lit("2024-01-06T10:00:00Z")),
        ),
        F.lit(',"schema_version":"1.0"'),
        F.when(value.between(8, 8.99), F.lit("")).otherwise(F.concat(F.lit(',"data":'), _data_text())),
        F.lit("}"),
        behind,
    )
    header = s.traceparent(F.md5("owner"), F.substring(F.md5("event_uuid"), 1, 16))
    text = F.when(value < 1, F.lit("{not json")).otherwise(text)
    return rows.select(
        F.col("order_uuid").alias("key"),
        # As a lambda's result, which keeps the text out of whole-stage code: in there, it is a method so large that
        # the JVM never compiles it.
        F.transform(F.array(text), lambda t: t)[0].alias("value"),
        F.array(
            F.struct(F.lit("traceparent").alias("key"), header.cast("binary").alias("value"))
        ).alias("headers"),
        # Four partitions whose offsets collide; a plan's messages are spread over them.
        (F.col("event_id") % 4).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 4).alias("offset"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
    )
