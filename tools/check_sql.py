"""Run the registered queries and their SQL twins side by side.

usage: python tools/check_sql.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trialweave.plans.oracles import ORACLES  # noqa: E402
from trialweave.plans.queries import QUERIES  # noqa: E402
from trialweave.session import get_spark  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = {}
    for c in df.columns:
        numeric = pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])
        if numeric:
            out[c] = df[c].map(lambda v: "null" if pd.isna(v) else repr(round(float(v), 6)))
        else:
            out[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)) else str(v))
    flat = pd.DataFrame(out)
    return flat.sort_values(list(flat.columns)).reset_index(drop=True)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = get_spark(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = []
    for name in args.names or QUERIES:
        try:
            start = time.time()
            got = QUERIES[name](spark, args.sf).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:28} {len(got):9} {took:6.1f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(ORACLES[name]).df()
            sql_took = time.time() - start
            assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
            a, b = normal(got), normal(want)
            if not a.equals(b):
                both = a.merge(b, how="outer", indicator=True)
                diff = both[both["_merge"] != "both"]
                bad.append(name)
                print(f"DIFF  {name:28} spark {len(a)} sql {len(b)} differing {len(diff)}\n{diff.head(6).to_string()}", flush=True)
            else:
                print(f"ok    {name:28} {len(a):9} {took:6.1f}s sql {sql_took:5.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name:28} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
