"""python tests/compare.py [SF_DIR] [NAME...]: each query against its SQL in DuckDB, by value."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x)) if isinstance(x, str) else "", x if not isinstance(x, (tuple, bool)) else str(x)) if x is not None else (True, "", 0) for x in row)


def differs(spark_rows: list[tuple], sql_rows: list[tuple]) -> str:
    """'' if both hold the same rows."""
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows, SQL has {len(sql_rows)}"
    a, b = sorted(spark_rows, key=key), sorted(sql_rows, key=key)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y or any(type(v) is not type(w) and v is not None for v, w in zip(x, y, strict=True))]
    return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]}" if wrong else ""


def compare(df, con, sql: str) -> str:
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    order = [rel.columns.index(n) for n in names]
    theirs = [tuple(norm(row[i]) for i in order) for row in rel.fetchall()]
    mine = [tuple(norm(x) for x in row) for row in df.select(*[f"`{n}`" for n in names]).collect()]
    return differs(mine, theirs)


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if names and name not in names and not any(name.startswith(n[:-1]) for n in names if n.endswith("*")):
            continue
        if not names and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            said = compare(f(spark, sf_dir), con, oracles[name]) if name in oracles else f"rows only: {f(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e).split("JVM stacktrace")[0][:600]
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
