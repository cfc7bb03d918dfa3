"""Single-node reference point: DuckDB on the same star schema.

    python tools/duckdb_baseline.py [sf_dir]

Loads the five mapped tables into an in-process DuckDB database once (timed
as "load"), then runs each oracle statement over them and fetches the full
result (timed per query). Prints one JSON line like bench.py.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from marginlens.plans.oracle import mapping_sql, query_sql_over_tables  # noqa: E402

RAW = "customer supplier part orders lineitem events".split()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    threads = os.environ.get("BENCH_CPUS")
    if threads:
        con.execute(f"SET threads = {int(threads)}")
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    times = {}
    t0 = time.perf_counter()
    for name, sql in mapping_sql().items():
        con.execute(f"CREATE TABLE {name} AS {sql}")
    times["load"] = round(time.perf_counter() - t0, 3)
    for name, sql in query_sql_over_tables().items():
        t0 = time.perf_counter()
        con.sql(sql).fetchall()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "engine": "duckdb",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "load_sec": times["load"], "query_sec": round(sum(v for k, v in times.items() if k != "load"), 3)}))


if __name__ == "__main__":
    main()
