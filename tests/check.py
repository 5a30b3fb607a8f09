"""Compare registered queries with DuckDB: ``python tests/check.py [name or prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _kind(values: pd.Series) -> str:
    found = {type(v) for v in values if not pd.isna(v)}
    if found <= {bool, np.bool_}:
        return "bool"
    if found <= {int, np.int64, np.int32, np.int16, float, np.float64, np.float32, bool, np.bool_}:
        return "number"
    return "other"


def _normal(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return repr(float(value))
    if isinstance(value, (float, np.floating)):
        return repr(float(value) + 0.0)
    if isinstance(value, (pd.Timestamp, np.datetime64)):
        return str(pd.Timestamp(value).tz_localize(None) if pd.Timestamp(value).tzinfo else pd.Timestamp(value))
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    lists = [[_normal(v) for v in frame[c].astype(object)] for c in columns]
    return sorted(zip(*lists)) if columns else []


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    left, right = rows_of(spark_frame), rows_of(sql_frame)
    if left == right:
        return None
    in_left, in_right = set(left), set(right)
    only_left = [r for r in left if r not in in_right][:3]
    only_right = [r for r in right if r not in in_left][:3]
    return f"{len(left)} rows != {len(right)} rows\n  spark only {only_left}\n  sql only   {only_right}"


def main() -> int:
    import __spark_entry__ as contract
    from quayside.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = sys.argv[1:]
    failed = 0
    for name, build in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            found = build(spark, folder).toPandas()
            sql = contract.oracle_sql().get(name)
            verdict = "no SQL" if sql is None else difference(found, con.execute(sql).df())
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
            found = ()
        bad = verdict not in (None, "no SQL")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} rows={len(found)} {time.time() - began:.2f}s {verdict or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
