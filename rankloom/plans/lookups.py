"""Queries of lookups: of sequences, families, databases and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import families
from rankloom.operators import joins as J
from rankloom.plans.functions import rule_matrix
from rankloom.plans.registry import query
from rankloom.sources import tables as S


@query("join_query_sequence", "SELECT o_orderkey AS query, c_name AS seq FROM orders JOIN customer ON o_custkey = c_custkey")
def join_query_sequence(spark, sf):
    """Every query's sequence; a query without one raises."""
    queries = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_custkey").alias("id"))
    return J.with_sequence(queries, S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("seq"))).select("query", "seq")


@query("join_blast_translation", "SELECT c_custkey AS read, n_name AS translation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def join_blast_translation(spark, sf):
    known = S.table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("translation"))
    return S.table(spark, sf, "customer").join(known, "c_nationkey", "left").select(F.col("c_custkey").alias("read"), "translation")


@query("join_pfam_taxid", "SELECT p_partkey AS row, c_custkey::INT AS taxid FROM part JOIN customer ON p_partkey = c_custkey")
def join_pfam_taxid(spark, sf):
    """Alignment rows by the part of their id before the slash; rows without a taxon are skipped."""
    rows = S.table(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.concat(F.col("p_partkey").cast("string"), F.lit("/1-90")).alias("row_id"))
    known = S.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("int").alias("taxid"))
    return rows.withColumn("id", F.substring_index("row_id", "/", 1)).join(known, "id").select("row", "taxid")


@query("join_rdp_superkingdom", "SELECT o_orderkey AS query, CASE WHEN c_nationkey < 8 THEN 'bacteria' WHEN c_nationkey < 16 THEN 'archaea' END AS kingdom FROM orders JOIN customer ON o_custkey = c_custkey")
def join_rdp_superkingdom(spark, sf):
    """An id in the first alignment, else in the second: one join with the union, first source wins."""
    c = S.table(spark, sf, "customer")
    first = c.where("c_nationkey < 8").select(F.col("c_custkey").alias("id"), F.struct(F.lit(1).alias("p"), F.lit("bacteria").alias("kingdom")).alias("k"))
    second = c.where("c_nationkey < 16").select(F.col("c_custkey").alias("id"), F.struct(F.lit(2).alias("p"), F.lit("archaea").alias("kingdom")).alias("k"))
    known = first.unionByName(second).groupBy("id").agg(F.min("k").alias("k"))
    return S.table(spark, sf, "orders").join(known, F.col("o_custkey") == F.col("id"), "left").select(F.col("o_orderkey").alias("query"), F.col("k.kingdom").alias("kingdom"))


@query("join_subject_taxid", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s_nationkey, 0) AS taxid FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON l_suppkey = s_suppkey")
def join_subject_taxid(spark, sf):
    known = S.table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.join(known, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("s_nationkey", F.lit(0)).alias("taxid"))


MEMBERS = "m AS (SELECT item_id, item_id % 8 AS family, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'ACDEFG') AS s FROM benchmark)"


@query("join_egt_family", f"""WITH {MEMBERS}, sc AS (SELECT a.item_id AS egt, b.item_id AS member, CASE WHEN least(length(a.s), length(b.s)) < 25 THEN 0 ELSE list_sum([CASE WHEN t[1] = t[2] THEN 4 ELSE -1 END FOR t IN list_zip(string_split(a.s, ''), string_split(b.s, ''), true)]) END AS score
 FROM m a JOIN m b ON a.family = b.family AND a.item_id <> b.item_id) SELECT egt, max_by(member, (score, -member)) AS member, max(score)::INT AS score FROM sc GROUP BY egt""")
def join_egt_family(spark, sf):
    """The best member of its family for each translation, itself left out: families are scored in blocks."""
    s = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUXZ", "ACDEFG")
    m = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") % 8).alias("family"), s.alias("row"))
    members = m.select("family", F.col("query").alias("member"), F.lit(0).alias("taxid"), F.col("row").alias("m_row"))
    return families.best_members(m, members, rule_matrix(), others=True).select(F.col("query").alias("egt"), "member", "score")
