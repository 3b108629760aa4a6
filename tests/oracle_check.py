"""Compares queries with their SQL: python tests/oracle_check.py [sf_dir] [name ...]. Not collected by pytest."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(frame):
    import math

    import pandas as pd

    cols = sorted(frame.columns)
    out = []
    for row in frame[cols].itertuples(index=False):
        cells = []
        for x in row:
            if x is None or x is pd.NA or x is not x or (isinstance(x, float) and math.isnan(x)):
                cells.append(None)
            elif hasattr(x, "item"):
                x = x.item()
                cells.append(round(x, 6) if isinstance(x, float) else x)
            else:
                cells.append(round(x, 6) if isinstance(x, float) else x)
        out.append(tuple(float(c) if isinstance(c, (int, float)) and not isinstance(c, bool) else c for c in cells))
    return cols, sorted(out, key=repr)


def compare(spark, con, name, function, sql, sf_dir):
    got = rows_of(function(spark, sf_dir).toPandas())
    want = rows_of(con.execute(sql).df())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        diff = next(((g, w) for g, w in zip(got[1], want[1]) if g != w), None)
        return f"{len(got[1])} and {len(want[1])} rows; first difference {diff}"
    return ""


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and name.startswith(("op", "pipeline")):
            continue
        t = time.time()
        try:
            said = compare(spark, con, name, f, sqls[name], sf) if name in sqls else f"no SQL, {f(spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:400]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
    print("different:", bad)
