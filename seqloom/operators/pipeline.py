"""Log in, order rows, outbox and dead letters out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from seqloom.operators import orders, sequence


@dataclass(frozen=True)
class Processed:
    gated: DataFrame
    guarded: DataFrame
    hot_orders: DataFrame | None

    @property
    def orders(self) -> DataFrame:
        return orders.order_state(self.guarded)

    @property
    def history(self) -> DataFrame:
        return orders.order_history(self.guarded, self.hot_orders)

    @property
    def outbox(self) -> DataFrame:
        return orders.outbox_rows(self.guarded)


def process_log(log: DataFrame) -> Processed:
    """Run a whole log: gate with store faults, then the order guard."""
    gated = sequence.seq_gate(orders.with_persist_error(log), store_faults=True)
    hot = orders.hot_orders(log)
    return Processed(gated, orders.order_guard(gated, hot), hot)
