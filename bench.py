"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from seqloom import session  # noqa: E402
from seqloom.plans import registry  # noqa: E402

HEADLINE = [
    "seq_gate_lineitem",
    "verdict_counts_lineitem",
    "applied_events",
    "seq_gate_store_faults",
    "order_state",
    "order_state_split_plans",
    "order_history",
    "outbox_rows",
    "gap_report",
    "plan_events",
    "e2e_report",
    "parse_envelope",
    "contract_report",
    "sink_dlq",
    "failure_streaks",
    "breaker_replay",
    "effective_config",
    "audit_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1))))
    names = sys.argv[1:] or HEADLINE
    spark = session.local("bench", cpus)
    # Start the JVM and its caches on something else.
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink computes every row and column and keeps none.
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if "seq_gate_lineitem" in seconds:
        line["gate_events_per_second"] = round(events / seconds["seq_gate_lineitem"])
    if "order_state" in seconds:
        line["pipeline_events_per_second"] = round(events / seconds["order_state"])
    print(json.dumps(line))


if __name__ == "__main__":
    main()
