"""Balanced contiguous chunks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunked(rows: DataFrame, key: str, n: int, runs: int = 256) -> DataFrame:
    """Adds chunk (from 1) over rows in order of a numeric key: n runs whose sizes differ by one, the longer ones first.

    Rows are cut into runs at approximate quantiles; counts of runs (at most `runs`) give each run's start, and
    places are numbered within runs only.
    """
    cuts = rows.agg(F.percentile_approx(key, [k / runs for k in range(1, runs)], 10_000).alias("c"), F.count(F.lit(1)).alias("n")).first()
    bounds, total = sorted(set(cuts["c"] or [])), cuts["n"]
    run = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    dealt = rows.withColumn("_run", run)
    starts = dealt.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = dealt.join(F.broadcast(starts), F.col("_run") == F.col("_r"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_run").orderBy(key)) - 1
    size, longer = total // n, total % n
    border = longer * (size + 1)
    chunk = F.when(place < border, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - border) / max(size, 1)))
    return placed.select(*rows.columns, (chunk + 1).cast("int").alias("chunk"))
