"""Run registered queries against their statements: python tests/check_queries.py [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from newsweave.plans.views import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, statement):
    """None when equal, else a description of the first differences."""
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(statement)
    names = [d[0] for d in cur.description]
    want = canon(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra = [g for g in got if g not in set(want)][:3]
        missing = [w for w in want if w not in set(got)][:3]
        return f"{len(got)} vs {len(want)} rows\n   spark only: {extra}\n   sql only:   {missing}"
    return None if got else "EMPTY"


def main():
    from __spark_entry__ import oracle_sql, queries
    from newsweave.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    wanted = sys.argv[1:]
    bad = []
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            statement = oracle_sql().get(name)
            if statement is None:
                rows = df.collect()
                note = f"rows only {len(rows)} {df.columns} {rows[:1]}"[:300]
                result = None if rows else "EMPTY"
            else:
                result, note = compare(df, con, statement), "sql"
        except Exception as error:  # noqa: BLE001
            result, note = f"{type(error).__name__}: {str(error)[:900]}", ""
        print(f"{'ok ' if result is None else 'BAD'} {name} {time.time() - started:.1f}s {note if result is None else result}", flush=True)
        if result is not None:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
