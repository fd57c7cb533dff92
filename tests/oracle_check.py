"""Run registered queries on Spark and their SQL twins on DuckDB, and compare whole results.

    python tests/oracle_check.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


SPARK_SECONDS: list[float] = []


def _full_key(row):
    return tuple((v is None, "" if v is None else (v if isinstance(v, (int, float, str)) else str(v))) for v in row)


def differences(spark_df, con, sql, limit: int = 3) -> list[str]:
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    want = relation.fetchall()
    got_names = spark_df.columns
    if sorted(names) != sorted(got_names):
        return [f"columns differ: spark {sorted(got_names)} sql {sorted(names)}"]
    order = sorted(names)
    start = time.time()
    got = [tuple(r[c] for c in order) for r in spark_df.collect()]
    SPARK_SECONDS.append(time.time() - start)
    place = [names.index(c) for c in order]
    want = [tuple(r[i] for i in place) for r in want]
    out = []
    if len(got) != len(want):
        out.append(f"rows differ: spark {len(got)} sql {len(want)}")
    if not want:
        out.append("oracle result is empty")
    got.sort(key=_full_key)
    want.sort(key=_full_key)
    bad = 0
    for g, w in zip(got, want):
        if g != w:
            bad += 1
            if bad <= limit:
                out.append(f"spark {dict(zip(order, g))}\n      sql   {dict(zip(order, w))}")
    if bad:
        out.append(f"{bad} of {len(want)} rows differ")
    for g in got:
        if any(isinstance(v, float) and math.isnan(v) for v in g):
            out.append("NaN in the Spark result")
            break
    return out


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from factorframe import build_session
    from factorframe.plans.catalogue import REGISTRY

    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                          "spark.driver.memory": "12g",
                                                          "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{args.sf}"
    con = connect(folder)
    failed = []
    chosen = [q for q in REGISTRY.values() if not args.names or any(q.name.startswith(n) for n in args.names)]
    for q in chosen:
        start = time.time()
        try:
            if q.sql is None:
                problems = [] if q.run(spark, folder).count() > 0 else ["no rows"]
            else:
                problems = differences(q.run(spark, folder), con, q.oracle())
        except Exception as error:  # noqa: BLE001
            text = str(error).strip().splitlines()
            problems = [f"{type(error).__name__}: " + "\n      ".join(text[:4])]
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
        took = time.time() - start
        print(f"{'ok  ' if not problems else 'FAIL'} {q.name:34s} {took:6.2f}s spark {SPARK_SECONDS[-1] if q.sql and SPARK_SECONDS else took:6.2f}s{'' if q.sql else '  (rows only)'}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
        if problems:
            failed.append(q.name)
    print(f"{len(chosen) - len(failed)} of {len(chosen)} equal; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
