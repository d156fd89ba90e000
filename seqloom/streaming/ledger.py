"""Order rows, outbox and dead letters kept current while the log is read.

One stream does the whole work: records are parsed, gated per plan, folded per
order by a second stateful operator behind the gate, and what comes out of a
micro-batch is one delta of a table. A delta counts from the moment its marker
file exists; a batch that Spark runs again after its marker was written changes
nothing, one that failed before is written anew.

Readers see marked deltas only. The rows of an order in several deltas are
resolved by the batch number, and when the deltas since the last base have grown
to a quarter of it, they are merged into the next base: keeping the table costs a
few times the deltas, whatever has been read before.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqloom.functions import scalars as s
from seqloom.functions import vocabulary as v
from seqloom.operators.replay import Lifetimes
from seqloom.streaming import gate

# --- what the stream writes: one row per kind; columns of other kinds are null ---
# kind: verdict, applied, abort, letter, order (the row after the batch), outbox
ROW = (
    f"{gate.OUTPUT}, status string, amount decimal(10,2), last_seq bigint, created_at timestamp, updated_at timestamp"
)
_FIELDS = [part.strip().split()[0] for part in ROW.replace("decimal(10,2)", "decimal").split(",")]
_OUT = Row(*_FIELDS)
# --- state of one order ---
STATE = (
    "status string, user_id string, amount decimal(10,2), plan_id string, last_seq bigint, "
    "created_at timestamp, updated_at timestamp"
)


class OrderRow:
    """An order's row: what an applied event or a tombstone makes of it."""

    def __init__(self, known: tuple | None):
        self.exists = known is not None
        self.status, self.user, self.amount, self.plan, self.last, self.created, self.updated = known or (None,) * 7

    def event(self, seq: int, status: str, user: str | None, amount: Decimal | None, plan: str, at) -> bool:
        """False if the order has that step or a later one already."""
        if self.exists and seq <= self.last:
            return False
        if not self.exists:
            self.exists, self.user, self.created = True, user or "unknown", at
        self.status, self.plan, self.last, self.updated = status, plan, seq, at
        if amount is not None:
            self.amount = amount
        return True

    def abort(self, at) -> bool:
        """True if it changed the row."""
        if not self.exists or self.status == v.STATUS_OF_EVENT[v.ABORT]:
            return False
        self.status, self.updated = v.STATUS_OF_EVENT[v.ABORT], at
        return True

    def values(self) -> tuple:
        return self.status, self.user, self.amount, self.plan, self.last, self.created, self.updated


class OrderFold(StatefulProcessor):
    """Folds a batch's applied events and tombstones into each order's row; other rows pass through.

    As in the gate, a key is a bucket of orders, and an order an entry of its state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._orders = handle.getMapState("order", "order_id string", STATE)

    def handleInputRows(self, key, rows, timerValues):
        orders = {}
        for row in rows:
            yield _OUT(*[row[f] for f in _FIELDS])
            if row["kind"] in ("applied", "abort") and row["persist_error"] is None:
                orders.setdefault(row["order_id"] or "", []).append(row)
        for order_id, taken in orders.items():
            yield from self._fold(order_id, taken)

    def _fold(self, order_id: str, taken: list):
        order, changed = OrderRow(gate.entry(self._orders, (order_id,))), False
        # Applied events in the order of application, tombstones at their own place.
        for row in sorted(taken, key=lambda r: (r["pos"], 0) if r["kind"] == "abort" else (r["applied_pos"], r["seq_id"])):
            if row["kind"] == "abort":
                at, accepted = row["ts"], True
                changed |= order.abort(at)
            else:
                at = row["applied_ts"]
                accepted = order.event(row["seq_id"], row["status"], row["user_id"], row["amount"], row["plan_id"], at)
                changed |= accepted
            if accepted:
                kept = {f: row[f] for f in _FIELDS}
                yield _OUT(*(kept | {"kind": "outbox", "created_at": at}).values())
        if changed:
            self._orders.updateValue((order_id,), order.values())
            kept = dict.fromkeys(_FIELDS) | {
                "kind": "order", "order_id": order_id, "status": order.status, "user_id": order.user, "amount": order.amount,
                "plan_id": order.plan, "last_seq": order.last, "created_at": order.created, "updated_at": order.updated,
            }
            yield _OUT(*kept.values())


def _folded(gated: DataFrame) -> DataFrame:
    none = {f: F.lit(None) for f in ("last_seq", "created_at", "updated_at")}
    kinds = {f.name: f.dataType for f in gated.sparkSession.createDataFrame([], ROW).schema.fields}
    # Amounts and statuses as in batch, before Python sees them.
    rows = gated.withColumns(
        {"status": s.status_of_event(F.col("event_type")), "amount": s.money(F.col("total_amount"))}
        | {f: c.cast(kinds[f]) for f, c in none.items()}
    )
    # Rows that only pass through are dealt out by their positions.
    taken = F.col("kind").isin("applied", "abort") & F.col("persist_error").isNull()
    key = F.when(taken, F.coalesce("order_id", F.lit(""))).otherwise(F.col("pos").cast("string"))
    rows = rows.select(*_FIELDS).withColumn("order_key", gate.bucket_of(key))
    return rows.groupBy("order_key").transformWithState(
        statefulProcessor=OrderFold(), outputStructType=ROW, outputMode="Append", timeMode="None"
    )


def _lettered(rows: DataFrame) -> DataFrame:
    """Adds the dead letters: what was rejected, timed out, or refused by the store."""
    kind = F.col("kind")
    refused = (kind == "applied") & F.col("persist_error").isNotNull()
    kinds = F.when(kind.isin("rejected", "timeout"), F.array(F.lit("letter"))).when(refused, F.array(kind, F.lit("letter"))).otherwise(F.array(kind))
    code = F.when(kind == "rejected", F.col("verdict")).when(kind == "timeout", F.lit(v.BUFFER_TIMEOUT)).when(refused, F.lit(v.DB_ERROR))
    reason = (
        F.when(code == v.PARSE_ERROR, F.lit(v.REASON_PARSE))
        .when(code == v.MISSING_SEQ_ID, F.lit(v.REASON_MISSING_SEQ))
        .when(code == v.BUFFER_TIMEOUT, F.lit(v.REASON_TIMEOUT))
        .when(refused, F.concat(F.lit(v.REASON_DB_PREFIX), F.col("persist_error")))
    )
    return rows.withColumns(
        {"error_code": code, "error_reason": reason, "kind": F.explode(kinds)}
    )


def pipeline(typed: DataFrame, lifetimes: Lifetimes = gate.STANDARD, delay: str = "10 minutes") -> DataFrame:
    """Parsed records (``wire.typed_rows``, streaming) to everything that comes of them, tagged by ``kind``."""
    return _lettered(_folded(gate.gate_records(typed, lifetimes, delay)))


def order_pipeline(log: DataFrame, lifetimes: Lifetimes = gate.STANDARD, delay: str = "10 minutes") -> DataFrame:
    """The same of a log of readable events; events without a step are left out."""
    return _lettered(_folded(gate.gate_stream(log, lifetimes, delay)))


class Ledger:
    """A folder of deltas, bases and markers; see the module."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, least: int = 100_000):
        self.spark, self.path, self.least = spark, path.rstrip("/"), least
        # As written: parts by kind; times without a zone like those of the batch tables.
        fields = [T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema.fields]
        self.schema = T.StructType(fields)

    def _files(self):
        context = self.spark.sparkContext
        marks = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks")
        return marks.getFileSystem(context._jsc.hadoopConfiguration()), context._jvm.org.apache.hadoop.fs.Path

    def marks(self) -> dict[str, dict]:
        """What has been committed: name of the folder -> rows by kind."""
        files, path = self._files()
        folder = path(f"{self.path}/marks")
        if not files.exists(folder):
            return {}
        out = {}
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("."):
                continue
            kinds = name.split("~")
            out[kinds[0]] = dict((k, int(n)) for k, n in (x.split("-") for x in kinds[1:]))
        return out

    def _mark(self, name: str, rows: dict[str, int]) -> None:
        """The marker's name holds all it says, so it exists wholly or not at all."""
        files, path = self._files()
        said = "~".join([name, *(f"{k}-{n}" for k, n in sorted(rows.items()))])
        files.create(path(f"{self.path}/marks/{said}"), True).close()

    def commit(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        name = f"batch={batch_id}"
        if name in self.marks():
            # Run again for the operators' state alone.
            batch.write.format("noop").mode("overwrite").save()
            return
        folder = f"{self.path}/{name}"
        ntz = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        batch.select(*ntz).write.mode("overwrite").partitionBy("kind").parquet(folder)
        counted = self.spark.read.schema(self.schema).parquet(folder).groupBy("kind").count().collect()  # a row per kind
        self._mark(name, {r["kind"]: r["count"] for r in counted})
        self.compact(batch_id)

    def _numbers(self, kind: str) -> tuple[int, list[int]]:
        """(the last batch the base holds, later committed batches that have rows of this kind)."""
        marks = self.marks()
        bases = [int(m.split("=")[1]) for m in marks if m.startswith("base=")]
        base = max(bases, default=-1)
        later = [int(m.split("=")[1]) for m, rows in marks.items() if m.startswith("batch=") and rows.get(kind)]
        return base, sorted(n for n in later if kind != "order" or n > base)

    def rows(self, kind: str) -> DataFrame:
        """All committed rows of a kind, with the number of their ``batch``."""
        _, numbers = self._numbers(kind)
        return self._read([f"{self.path}/batch={n}/kind={kind}" for n in numbers])

    def _read(self, folders: list[str]) -> DataFrame:
        kept = T.StructType([f for f in self.schema.fields if f.name != "kind"])
        schema = T.StructType([*kept.fields, T.StructField("batch", T.LongType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", self.path).schema(schema).parquet(*folders)

    def _orders(self) -> DataFrame:
        """The last row of each order: the base without the orders of later deltas, and the last rows of those."""
        base, numbers = self._numbers("order")
        later = self._read([f"{self.path}/batch={n}/kind=order" for n in numbers])
        held = [c for c in later.columns if c != "order_id"]
        latest = later.groupBy("order_id").agg(F.max_by(F.struct(*held), "batch").alias("_r")).select("order_id", "_r.*")
        if base < 0:
            return latest
        before = self.spark.read.schema(latest.schema).parquet(f"{self.path}/base={base}")
        return before.join(latest.select("order_id"), "order_id", "left_anti").unionByName(latest)

    def compact(self, batch_id: int) -> None:
        """Merge the deltas into a new base once they are a quarter of the last one."""
        marks = self.marks()
        base, numbers = self._numbers("order")
        grown = sum(marks[f"batch={n}"]["order"] for n in numbers)
        if grown < max(self.least, marks.get(f"base={base}", {}).get("order", 0) / 4):
            return
        folder = f"{self.path}/base={batch_id}"
        self._orders().write.mode("overwrite").parquet(folder)
        self._mark(f"base={batch_id}", {"order": self.spark.read.parquet(folder).count()})

    def orders(self) -> DataFrame:
        """The order table as of the last committed batch."""
        return self._orders().select(
            F.col("order_id").alias("id"),
            "user_id",
            "status",
            F.col("amount").alias("total_amount"),
            "plan_id",
            F.col("last_seq").alias("last_seq_processed"),
            "created_at",
            "updated_at",
        )

    def outbox(self) -> DataFrame:
        return self.rows("outbox").select(
            s.stable_uuid(F.lit("outbox"), F.col("plan_id"), F.col("event_id"), F.col("pos")).alias("id"),
            F.col("order_id").alias("aggregate_id"),
            "event_type",
            "payload",
            F.lit(v.OUTBOX_TOPIC).alias("topic"),
            F.lit(False).alias("processed"),
            "created_at",
        )

    def letters(self) -> DataFrame:
        """Dead letters of all five codes: the key and the event of what could be read, the raw text of the rest."""
        unread = F.col("error_code") == v.PARSE_ERROR
        event = F.struct("event_id", "event_type", "plan_id", "seq_id", "order_id", "payload")
        return self.rows("letter").select(
            "pos",
            F.when(~unread, F.col("order_id")).alias("key"),
            F.when(~unread, event).alias("original_event"),
            F.when(unread, F.col("payload")).alias("raw"),
            "error_reason",
            "error_code",
            F.coalesce("applied_ts", "ts").alias("failed_at"),
            F.when(~unread, F.col("event_id")).alias("original_event_id"),
        )


def run(out: DataFrame, path: str, least: int = 100_000, commit=None) -> Ledger:
    """Run a pipeline to the end of its input and keep the table in ``path`` (which also holds the checkpoint)."""
    ledger = Ledger(out.sparkSession, f"{path}/table", out.schema, least)
    writer = out.writeStream.foreachBatch(commit or ledger.commit).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return ledger
