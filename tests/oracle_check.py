"""Compare registered queries with their DuckDB oracles.

python -m tests.oracle_check [sf] [name ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple("<null>" if pd.isna(v) else _text(v) for v in row)
        for row in frame.itertuples(index=False, name=None)
    ]
    return sorted(rows)


def _text(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, int):
        return repr(v)
    return str(v)


def differences(spark, con, sf_dir, name, query, sql):
    got = query(spark, sf_dir).toPandas()
    want = con.sql(sql).df()
    problems = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"], len(got)
    for c in got.columns:
        if got[c].dtype.kind != want[c].dtype.kind and got[c].notna().any():
            problems.append(f"{c}: {got[c].dtype} != {want[c].dtype}")
    a, b = canonical(got.astype(object)), canonical(want.astype(object))
    if a != b:
        in_a, in_b = set(a), set(b)
        extra = [r for r in a if r not in in_b][:3]
        missing = [r for r in b if r not in in_a][:3]
        problems.append(f"rows {len(a)} vs {len(b)}; only spark {extra}; only sql {missing}")
    return problems, len(a)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from seqloom import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session.local("oracle-check")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problems, n = differences(spark, con, sf_dir, name, queries[name], oracles[name])
            else:
                problems, n = [], queries[name](spark, sf_dir).count()
        except Exception as e:  # report and go on with the next query
            problems, n = [f"{type(e).__name__}: {str(e)[:600]}"], -1
        bad += bool(problems)
        kind = "sql" if name in oracles else "rows"
        print(f"{name:32} {kind:4} {n:8} {time.time() - start:6.2f}s {problems or 'ok'}", flush=True)
    print("failing:", bad)
