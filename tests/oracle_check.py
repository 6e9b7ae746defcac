"""Compare registered queries with their SQL in DuckDB: python tests/oracle_check.py [sf] [name-part ...]"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float",
         "string": "str", "boolean": "bool", "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int",
         "FLOAT": "float", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool",
         "timestamp": "ts", "timestamp_ntz": "ts", "TIMESTAMP": "ts", "date": "date", "DATE": "date"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    kinds = [KINDS.get(dict(df.dtypes)[n], dict(df.dtypes)[n]) for n in names]
    rows = [tuple(cell(r[n]) for n in names) for r in df.collect()]
    return names, kinds, sorted(rows, key=repr)


def sql_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    names = [rel.columns[i] for i in order]
    kinds = [KINDS.get(str(rel.types[i]), str(rel.types[i])) for i in order]
    rows = [tuple(cell(r[i]) for i in order) for r in rel.fetchall()]
    return names, kinds, sorted(rows, key=repr)


def compare(spark, con, sf_dir, name, fn, sql) -> str:
    df = fn(spark, sf_dir)
    if sql is None:
        n = df.count()
        return f"rows-only {n}"
    a, b = spark_rows(df), sql_rows(con, sql)
    if a[0] != b[0]:
        return f"FAIL columns {a[0]} / {b[0]}"
    if a[1] != b[1]:
        return f"FAIL types {list(zip(a[0], a[1], b[1]))}"
    if len(a[2]) != len(b[2]):
        return f"FAIL rows {len(a[2])} / {len(b[2])}"
    bad = [(x, y) for x, y in zip(a[2], b[2]) if x != y]
    if bad:
        return f"FAIL values {len(bad)} of {len(a[2])}: {bad[0][0]} / {bad[0][1]}"
    return f"ok {len(a[2])}" + (" EMPTY" if not a[2] else "")


def main() -> int:
    from bandweave.session import get_spark
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            text = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # report and go on
            text = "FAIL " + type(error).__name__ + " " + " ".join(str(error).split())[:600]
        if text.startswith("FAIL") or "EMPTY" in text:
            failed.append(name)
        print(f"{name:42s} {time.time() - start:6.2f}s  {text}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
