"""The driver's tables as taxonomy, names and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.ranks import rank_name

#: r_regionkey: (taxid, rank, parent).
REGIONS = {0: (2, 1, 131567), 1: (2157, 1, 131567), 2: (2759, 1, 131567), 3: (10239, 1, 1), 4: (12908, 0, 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, n and the ids of a customer's class, order, family and genus."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), "c_mktsegment", "c_name")
    segments = rows.select("c_mktsegment").distinct().withColumn("s", F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1)
    rows = rows.join(F.broadcast(segments), "c_mktsegment")  # five segments
    rows = rows.withColumn("i8", F.col("n") * 10 + F.col("s"))
    rows = rows.withColumn("i14", F.col("i8") * 3 + F.col("c") % 3)
    rows = rows.withColumn("i19", F.col("i14") * 5 + F.col("c") % 5)
    return rows.withColumn("i23", F.col("i19") * 7 + F.col("c") % 7)


def _region_id(key: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, (taxid, _, _) in REGIONS.items():
        out = F.when(key == k, taxid).otherwise(out)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxid, parent, rank: the taxonomy, a few rows for each customer."""
    c = customers(spark, sf_dir)
    fixed = spark.createDataFrame([(1, 1, 0), (131567, 1, 0), *((t, p, r) for t, r, p in REGIONS.values())], "taxid int, parent int, rank int")
    nation = table(spark, sf_dir, "nation").select((100000 + F.col("n_nationkey")).alias("taxid"), _region_id(F.col("n_regionkey")).alias("parent"), F.lit(5).alias("rank"))
    level = lambda base, child, up, parent, rank: c.select((base + F.col(child)).alias("taxid"), (up + F.col(parent)).alias("parent"), F.lit(rank).alias("rank")).distinct()
    out = fixed.union(nation)
    for part in (level(200000, "i8", 100000, "n", 8), level(300000, "i14", 200000, "i8", 14), level(400000, "i19", 300000, "i14", 19), level(500000, "i23", 400000, "i19", 23), level(1000000, "c", 500000, "i23", 27)):
        out = out.union(part)
    return out.select(*[F.col(x).cast("int").alias(x) for x in ("taxid", "parent", "rank")])


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxid, name, class, ord: scientific names of regions, nations and customers, and some synonyms."""
    c = customers(spark, sf_dir)
    region = table(spark, sf_dir, "region").select(_region_id(F.col("r_regionkey")).alias("taxid"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select((100000 + F.col("n_nationkey")).alias("taxid"), F.col("n_name").alias("name"))
    species = c.select((1000000 + F.col("c")).alias("taxid"), F.col("c_name").alias("name"))
    own = region.union(nation).union(species).withColumn("class", F.lit("scientific name"))
    other = c.where("c % 10 = 0").select((1000000 + F.col("c")).alias("taxid"), F.concat(F.lit("Syn "), "c_name").alias("name"), F.lit("synonym").alias("class"))
    return own.union(other).select(F.col("taxid").cast("int").alias("taxid"), "name", "class")


def hits(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """query, ord, taxid, score, aln_len, ev (e-value class), part, supp of each line item, as hits of its order, with `more` columns of customers().

    Orders meet customers first, so line items are shuffled once, by their order, whose window needs just that.
    """
    c = customers(spark, sf_dir)
    n = table(spark, sf_dir, "customer").count()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(c.select("c", "i8", "i14", "i19", "i23", *[x for x in more if x != "c"]), F.col("o_custkey") == F.col("c"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.col("l_partkey") % 8
    taxid = F.when(kind == 3, 500000 + F.col("i23")).when(kind == 4, 400000 + F.col("i19")).when(kind == 5, 300000 + F.col("i14")).when(kind == 6, 200000 + F.col("i8"))
    taxid = taxid.when(kind == 7, 1000000 + (F.col("c") + F.col("l_suppkey")) % n).otherwise(1000000 + F.col("c"))
    # Named before the window, so that what follows finds the rows dealt by query.
    rows = rows.withColumnRenamed("l_orderkey", "query")
    order = Window.partitionBy("query").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return rows.select(
        "query",
        F.row_number().over(order).alias("ord"),
        taxid.cast("int").alias("taxid"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("score"),
        F.col("l_quantity").cast("int").alias("aln_len"),
        F.round(F.col("l_discount") * 100).cast("int").alias("ev"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("o_orderpriority").alias("sample"),
        *more,
    )


def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy as lines of its text form."""
    return nodes(spark, sf_dir).select(F.concat_ws("\t|\t", F.col("taxid").cast("string"), F.col("parent").cast("string"), F.concat(rank_name(F.col("rank")), F.lit("\t|"))).alias("value"))
