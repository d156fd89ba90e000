"""Messages on the log: raw records, parsing, message text, dead letters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v

# --- fixed values: envelope fields and the JSON kinds the parser takes for them ---
TEXT_FIELDS = ["event_id", "event_type", "plan_id", "order_id", "timestamp", "schema_version"]
MAX_PARTITIONS = 4096
RAW_SCHEMA = (
    "key string, value string, headers array<struct<key:string,value:binary>>, "
    "partition int, offset bigint, timestamp timestamp_ntz"
)


def read_log_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The topic as a stream; needs the Kafka package on the cluster."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
        .option("maxOffsetsPerTrigger", "50000000")
        .load()
    )
    return records.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "headers",
        "partition",
        "offset",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
    )


def read_log_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same records as a stream of Parquet files."""
    return (
        spark.readStream.schema(RAW_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def header_map(headers: Column) -> Column:
    """Header list to map; of repeated keys the last one counts."""
    keys = F.array_distinct(F.transform(headers, lambda h: h["key"]))
    last = lambda k: F.element_at(F.filter(headers, lambda h: h["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, lambda k: last(k).cast("string")))


ENVELOPE = (
    "event_id string, event_type string, plan_id string, seq_id bigint, order_id string, "
    "timestamp string, schema_version string, data variant"
)


def _kind(message: Column | str, field: str) -> Column:
    return s.variant_kind(F.try_variant_get(message, f"$.{field}", "variant"))


def _well_typed() -> Column:
    """Text fields are strings, the step number an integer, ``data`` an object,
    as far as they are there at all."""
    kinds = {f: "STRING" for f in TEXT_FIELDS} | {"seq_id": "BIGINT", "data": "OBJECT"}
    # Paths are literals: Spark reads a path that is a column anew for every row.
    fits = [F.coalesce(_kind("_m", f), F.lit("VOID")).isin("VOID", k) for f, k in kinds.items()]
    return reduce(Column.__and__, fits)


def last_key_wins(spark: SparkSession) -> None:
    """Have JSON objects with a repeated key read as the last value, not as broken text."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def whole_json(text: Column) -> Column:
    """The text as a VARIANT if it is one JSON value and nothing else; null otherwise.

    The parser ignores what follows a value. Here the text stands in a list in front
    of its own digest: only if it is one value is the digest the second member, and
    no text can bring its own digest along.
    """

    def sealed(digest: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
        whole = lambda m: F.try_variant_get(m, "$[1]", "string") == digest
        return _once(listed, lambda m: F.when(whole(m), F.try_variant_get(m, "$[0]", "variant")))

    return _once(F.sha2(text, 256), sealed)


def parse_envelope(raw: DataFrame) -> DataFrame:
    """Typed envelope columns and ``parse_ok``.

    Strict: text fields must be JSON strings, the step number a JSON integer,
    ``data`` an object. Absent and null fields are empty, not errors. Of a key
    that occurs twice the last value counts; steps are 64-bit numbers. Text behind
    the message makes it unreadable.
    """
    last_key_wins(raw.sparkSession)
    ok = s.variant_kind(F.col("_m")).isin("OBJECT", "VOID") & _well_typed()
    texts = {
        "sent_at" if f == "timestamp" else f: F.coalesce(
            F.col(f"_e.{f}"), F.when(F.col("_p.ok"), F.lit(""))
        )
        for f in TEXT_FIELDS
    }
    parsed = raw.withColumn("_m", whole_json(F.col("value"))).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    envelope = F.when(F.col("_ok"), F.from_json("value", ENVELOPE))
    # As a generator, so that later filters on parsed fields stay above it and
    # do not parse every message once more.
    once = F.explode(F.array(F.struct(F.col("_ok").alias("ok"), envelope.alias("envelope"))))
    parsed = parsed.select(*raw.columns, once.alias("_p")).withColumn("_e", F.col("_p.envelope"))
    return parsed.withColumns(
        {
            "parse_ok": F.col("_p.ok"),
            **texts,
            "seq_id": F.col("_e.seq_id"),
            "data": F.col("_e.data"),
        }
    ).drop("_p", "_e")


def payload_fields(data: Column) -> dict[str, Column]:
    """``user_id`` only if it is a string, ``total_amount`` only if a number."""
    user, amount = _kind(data, "user_id"), _kind(data, "total_amount")
    return {
        "user_id": F.when(
            user.isin(*s.KINDS["string"]), F.try_variant_get(data, "$.user_id", "string")
        ),
        "total_amount": F.when(
            amount.isin(*s.KINDS["number"]), F.try_variant_get(data, "$.total_amount", "double")
        ),
    }


def message_text() -> Column:
    """Envelope text with ``event_id`` first, so that the smallest text is the
    one with the smallest event id."""
    return F.to_json(
        F.struct(
            "event_id",
            "event_type",
            "plan_id",
            "seq_id",
            "order_id",
            F.col("sent_at").alias("timestamp"),
            "schema_version",
            "data",
        )
    )


def position() -> Column:
    """One number for (offset, partition): order within a partition is kept, and no two records share it.

    A topic with more than MAX_PARTITIONS partitions is refused, as its positions would collide.
    """
    beyond = F.raise_error(F.format_string("partition %d is beyond the limit of %d", "partition", F.lit(MAX_PARTITIONS)))
    part = F.when(F.col("partition") < MAX_PARTITIONS, F.col("partition")).otherwise(beyond.cast("int"))
    return F.col("offset") * MAX_PARTITIONS + part


def typed_rows(parsed: DataFrame, *more: str) -> DataFrame:
    """The log columns of every message, with ``parse_ok`` and the raw text of
    those that cannot be read. Positions are unique over all partitions: offset,
    then partition."""
    return parsed.select(
        "parse_ok",
        F.when(~F.col("parse_ok"), F.col("value")).alias("raw"),
        "plan_id",
        "order_id",
        "seq_id",
        "event_id",
        "event_type",
        F.col("timestamp").alias("ts"),
        position().alias("pos"),
        F.when(F.col("parse_ok"), message_text()).alias("payload"),
        *[c.alias(name) for name, c in payload_fields(F.col("data")).items()],
        *more,
    )


def log_of(typed: DataFrame) -> DataFrame:
    """The readable messages as an event log."""
    return typed.filter("parse_ok").drop("parse_ok", "raw")


def to_records(events: DataFrame, value: Column) -> DataFrame:
    """Keyed messages with a traceparent header, ready for a log sink.

    The events of a plan leave one task in step order, so no shuffle is needed;
    the sink partitions by key.
    """
    header = s.traceparent(F.md5("plan_id"), F.substring(F.md5("event_id"), 1, 16))
    return events.select(
        F.col("order_id").alias("key"),
        value.alias("value"),
        F.array(
            F.struct(F.lit("traceparent").alias("key"), header.cast("binary").alias("value"))
        ).alias("headers"),
    )


def _dead_letter(df: DataFrame, code: str, reason: Column, raw: Column | None = None) -> DataFrame:
    event = F.struct("event_id", "event_type", "plan_id", "seq_id", "order_id", "payload")
    none = F.lit(None)
    is_raw = raw is not None
    return df.select(
        (none.cast("string") if is_raw else F.col("order_id")).alias("key"),
        (F.when(F.lit(False), event) if is_raw else event).alias("original_event"),
        (raw if is_raw else none.cast("string")).alias("raw"),
        reason.alias("error_reason"),
        F.lit(code).alias("error_code"),
        F.col("ts").alias("failed_at"),
        (none.cast("string") if is_raw else F.col("event_id")).alias("original_event_id"),
        "pos",
    )


def dead_letters(typed: DataFrame, gated: DataFrame) -> DataFrame:
    """Everything that failed: unreadable, without a step number, refused by the store."""
    unread = typed.filter(~F.col("parse_ok"))
    missing = log_of(typed).filter(F.col("seq_id").isNull() & (F.col("event_type") != v.ABORT))
    refused = gated.filter(F.col("applied") & F.col("persist_error").isNotNull())
    refused = refused.withColumn("ts", F.col("applied_ts"))
    reason = F.concat(F.lit(v.REASON_DB_PREFIX), F.col("persist_error"))
    return (
        _dead_letter(unread, v.PARSE_ERROR, F.lit(v.REASON_PARSE), F.col("raw"))
        .unionByName(_dead_letter(missing, v.MISSING_SEQ_ID, F.lit(v.REASON_MISSING_SEQ)))
        .unionByName(_dead_letter(refused, v.DB_ERROR, reason))
    )


def dead_letter_records(letters: DataFrame) -> DataFrame:
    """Dead letters as messages: raw text as it came, or the event with its error."""
    body = F.to_json(F.struct("original_event", "error_reason", "error_code", "failed_at"))
    names = ["error_reason", "error_code", "original_event_id"]
    headers = F.array(
        *[F.struct(F.lit(n).alias("key"), F.col(n).cast("binary").alias("value")) for n in names]
    )
    return letters.select(
        "key",
        F.coalesce("raw", body).alias("value"),
        F.filter(headers, lambda h: h["value"].isNotNull()).alias("headers"),
    )
