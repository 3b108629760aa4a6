"""Helpers shared by the operators: shared storage, exact running totals, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: the characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of a batch of rows on its way to Python. Spark's own bound is 10,000 rows or 64 MB; executor and worker hold a batch several times over.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; the driver's JVM deletes it when it ends."""
    path = f"{shared_dir(spark)}/rankloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path below the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rankloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), when nothing reads it any more."""
    delete(df.sparkSession, df._rankloom_path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches to Python by BATCH_BYTES, and one row more; a lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def small_enough(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows (of a few longs each), counted now."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def constants(values: list, kind: str) -> Column:
    """An array of numbers as one constant: a literal for each is a call of the driver's JVM."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= key (null: 0): a binary search inside one expression."""
    if not bounds:
        return F.lit(0)
    steps = []
    size = 1
    while size <= len(bounds):
        steps.append(size)
        size *= 2
    held = constants([int(b) for b in bounds], "long")
    pick = lambda p, s: F.when(F.get(held, p + s - 1) <= key, p + s).otherwise(p)
    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), pick), F.lit(0))


def even_bounds(df: DataFrame, key: Column, buckets: int) -> list[int]:
    """At most buckets - 1 distinct longs that cut the keys into runs of about as many rows. Bounded: buckets."""
    if buckets < 2:
        return []
    cuts = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, constants(cuts, "double"), max(10_000, 4 * buckets)).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_count(rows: int, per_bucket: int = 64, most: int = 2048) -> int:
    return max(1, min(most, rows // per_bucket))


def running_total(df: DataFrame, key: Column, order: list[Column], values: dict[str, Column], groups: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Adds, for each name of `values`, the sum of that column over all rows before this one in (key, *order), null keys first.

    Rows are dealt into runs of neighbouring keys; the runs' sums are added up first (as many rows as
    there are runs), then each run is summed by itself, so no task holds more than a run.
    `key` is a long column; `order` breaks its ties. With `groups`, totals start anew in each group.
    """
    groups = list(groups or [])
    n = buckets or bucket_count(df.count())
    cut = df.withColumn("_run", bucket_of(key, even_bounds(df, key, n)))
    by = [*groups, "_run"]
    sums = cut.groupBy(*by).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    before = Window.partitionBy(*groups).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias(f"_g_{g}") for g in by], *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in values])
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col("_run") == F.col("_g__run")]
    own = Window.partitionBy(*by).orderBy(key.asc_nulls_first(), *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(base, on=same, how="left")
    for k, v in values.items():
        joined = joined.withColumn(k, F.col(f"_base_{k}") + F.coalesce(F.sum(v).over(own), F.lit(0)))
    return joined.drop("_run", *[f"_g_{g}" for g in by], *[f"_base_{k}" for k in values])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of the undirected links, the smallest node that it reaches.

    Alternates large-star and small-star steps until only stars are left; each step is two shuffles of
    the links, and each round is written to the shared folder, so lineage stays short.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while True:
        # Done when all edges are stars: every node has one end, and no end has one of its own.
        role = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        role = role.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not role.where("up + down > 1").limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u")
        small = hop.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hop.select("u", F.col("m").alias("v"))).distinct()
        following = written(small, "links")
        drop(edges)
        edges = following
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
