"""Queries of reports, organism names, number formats, 16S preparation and the modes on aligned rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import formats, ranks, sequence as Q
from rankloom.operators import modes
from rankloom.operators import organisms as G
from rankloom.operators import taxonomy as T
from rankloom.plans import oracle as O
from rankloom.plans.functions import rule_matrix
from rankloom.plans.parsing import listed_others, name_rows
from rankloom.plans.registry import query
from rankloom.plans.taxonomy import tree
from rankloom.sources import parsers as P
from rankloom.sources import tables as S


@query("scan_blast_index", """WITH l AS (SELECT 'f' || o_orderkey % 4 AS file, o_orderkey * 4 AS ord, 'BLASTP 2.2' AS value, o_orderkey AS q FROM orders
 UNION ALL SELECT 'f' || o_orderkey % 4, o_orderkey * 4 + 1, 'Query= o' || o_orderkey % 1000, o_orderkey FROM orders UNION ALL SELECT 'f' || o_orderkey % 4, o_orderkey * 4 + 2, o_orderpriority, o_orderkey FROM orders),
s AS (SELECT *, coalesce(sum(strlen(value) + 1) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT file, 'o' || q % 1000 AS query, min(start)::BIGINT AS "offset" FROM s WHERE value = 'BLASTP 2.2' GROUP BY file, q % 1000""")
def scan_blast_index(spark, sf):
    k = F.col("o_orderkey")
    parts = F.array(F.lit("BLASTP 2.2"), F.concat(F.lit("Query= o"), (k % 1000).cast("string")), F.col("o_orderpriority"))
    lines = S.table(spark, sf, "orders").select(F.concat(F.lit("f"), (k % 4).cast("string")).alias("file"), k, F.posexplode(parts).alias("k", "value"))
    return P.blast_index(lines.select("file", (k * 4 + F.col("k")).alias("ord"), "value"))


@query("scan_reciprocal_report", """SELECT l_orderkey::VARCHAR AS "group", max_by(l_quantity, l_quantity::VARCHAR) FILTER (l_linenumber = 1) AS self_score, max_by(l_quantity, l_quantity::VARCHAR) FILTER (l_linenumber = 2) AS query_score,
 count(*) FILTER (l_linenumber > 2 AND l_quantity >= 20) AS n_others, coalesce(string_agg(l_partkey || ':' || l_quantity::INT, ',' ORDER BY l_partkey || chr(10), l_quantity::VARCHAR) FILTER (l_linenumber > 2 AND l_quantity >= 20), '') AS others FROM lineitem GROUP BY l_orderkey""")
def scan_reciprocal_report(spark, sf):
    n = F.col("l_linenumber")
    subject = F.when(n == 1, "self").when(n == 2, "query").otherwise(F.col("l_partkey").cast("string"))
    block = F.concat(F.lit("\n>"), subject, F.lit("\n          Length = 90\n\n Score = "), F.col("l_quantity").cast("string"), F.lit(" bits (9), Expect = 1e-5\n\n Score = 999.0 bits (9), Expect = 1e-5\n"))
    rows = S.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(block)), "").alias("blocks"))
    return listed_others(P.reciprocal_report(rows.select(F.concat(F.lit("Query= "), F.col("l_orderkey").cast("string"), F.lit("\n"), "blocks").alias("value")), 20))


@query("number_formats", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%g', l_extendedprice / 3.7::DOUBLE) AS a, printf('%g', l_extendedprice * 1000 / 3.7::DOUBLE) AS b, printf('%g', l_quantity / l_extendedprice / 700) AS c, printf('%g', 100000 + l_partkey + 0.5::DOUBLE) AS d, printf('%g', (1000005 + 10 * l_partkey) / 10000000::DOUBLE) AS e FROM lineitem")
def number_formats(spark, sf):
    rows = S.table(spark, sf, "lineitem")
    a, b, c = F.col("l_extendedprice") / 3.7, F.col("l_extendedprice") * 1000 / 3.7, F.col("l_quantity") / F.col("l_extendedprice") / 700
    d, e = 100000 + F.col("l_partkey") + 0.5, (1000005 + 10 * F.col("l_partkey")) / 10000000
    return formats.with_six_digits(rows, {"a": a, "b": b, "c": c, "d": d, "e": e}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a", "b", "c", "d", "e")


@query("organism_name", "SELECT c_custkey AS c, CASE WHEN c_custkey % 5 = 3 THEN 0 ELSE 1000000 + c_custkey END::INT AS taxid FROM customer")
def organism_name(spark, sf):
    """Descriptions of five kinds; those of the fourth name nothing."""
    c, name = F.col("c_custkey") % 5, F.col("c_name")
    header = F.when(c == 0, F.concat(F.lit(">gi|1|x protein ["), name, F.lit("]"))).when(c == 1, F.concat(F.lit(">pir|x|y thing - "), name, F.lit(" (strain zz)")))
    header = header.when(c == 2, F.concat(F.lit(">gi|1|x thing from "), name)).when(c == 3, F.lit(">gi|1|x [nothing here] odd")).otherwise(F.concat(F.lit(">gi|1|x ["), name, F.lit(", isolate [7]]")))
    rows = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), header.alias("header"))
    return G.organism_taxid(rows, "c", "header", P.name_to_taxid(name_rows(spark, sf)))


@query("rdp_taxid_map", O.sql("SELECT 'S' || c_custkey AS id, coalesce(taxid, 0)::INT AS taxid FROM customer LEFT JOIN (SELECT lower(name) AS nm, max(taxid) AS taxid FROM names GROUP BY 1) ON nm = lower(CASE WHEN c_custkey % 4 = 0 THEN 'Syn ' || c_name WHEN c_custkey % 4 = 1 THEN 'odd one' ELSE c_name END)", O.NODES, O.NAMES))
def rdp_taxid_map(spark, sf):
    """Ids of 16S headers with the taxon of their organism: names, synonyms and what names nothing."""
    k = F.col("c_custkey")
    organism = F.when(k % 4 == 0, F.concat(F.lit("Syn "), "c_name")).when(k % 4 == 1, "odd one").otherwise(F.col("c_name"))
    lines = S.table(spark, sf, "customer").select(F.concat(F.lit(">S"), k.cast("string"), F.lit(" "), organism, F.lit("; 16S; OFFSET4")).alias("value"))
    return G.record_taxa(P.rdp_header(lines), P.name_to_taxid(name_rows(spark, sf)))


@query("specific_rdp", O.sql("""SELECT '>S' || taxid || '_' || taxid || ' OFFSET' || (length(cells) - length(ltrim(cells, '-'))) || chr(10) || trim(cells, '-') AS record, 'S' || taxid AS id, taxid FROM keep""", *O.TREE, """,
spec AS (SELECT taxid FROM lin WHERE rank >= 27 AND list_contains(rks, 5) AND list_contains(rks, 23) AND ids[list_position(rks, 23)] % 11 <> 0),
raw AS (SELECT taxid, repeat('-', taxid % 4) || substring(md5(taxid::VARCHAR), 1, 9) || repeat('-', 1 + taxid % 3) || substring(md5(taxid::VARCHAR), 9, 7) || repeat('-', 5 - taxid % 5) AS broad FROM spec),
cut AS (SELECT taxid, substring(translate(broad, '0123456789abcdef', 'ACG-ACG-ACG-ACGT'), 1, 18) AS aligned FROM raw),
used AS (SELECT list(pos ORDER BY pos) AS kept FROM (SELECT DISTINCT pos FROM (SELECT unnest(string_split(aligned, '')) AS c, generate_subscripts(string_split(aligned, ''), 1) AS pos FROM cut) WHERE c <> '-')),
keep AS (SELECT taxid, array_to_string(list_transform(kept, lambda p: substring(aligned, p, 1)), '') AS cells FROM cut, used WHERE length(replace(aligned, '-', '')) > 0)"""))
def specific_rdp(spark, sf):
    """Rows with gaps inside and outside; columns of gaps alone go, and offsets are those of what is left."""
    t, text = F.col("taxid"), F.md5(F.col("taxid").cast("string"))
    gaps = lambda n: F.repeat(F.lit("-"), n.cast("int"))
    full = F.concat(gaps(t % 4), F.substring(text, 1, 9), gaps(1 + t % 3), F.substring(text, 9, 7), gaps(5 - t % 5))
    rows = tree(spark, sf).select(F.concat(F.lit("S"), t.cast("string")).alias("id"), "taxid", F.substring(F.translate(full, "0123456789abcdef", "ACG-ACG-ACG-ACGT"), 1, 18).alias("aligned"))
    names = tree(spark, sf).where("rank = 23").select("taxid", F.when(t % 11 == 0, "environmental samples").otherwise("genus").alias("name"))
    return G.specific_records(rows, tree(spark, sf), names, [], 19)


CELLULAR_SPECIES = "WHERE rank = 27 AND list_contains(ids, 131567)"


def _sequences(spark, sf):
    """A sequence of each cellular species, and a name of each node."""
    nodes = tree(spark, sf)
    t = F.col("taxid")
    rows = nodes.where((F.col("rank") == 27) & F.array_contains(ranks.taxids(F.col("path")), ranks.CELLULAR)).select(F.concat(F.lit("S"), t.cast("string")).alias("id"), "taxid", F.substring(F.lit("ACGT"), t % 4 + 1, F.lit(1)).alias("seq"))
    return rows, nodes, nodes.select("taxid", F.concat(F.lit("n"), t.cast("string")).alias("name"))


@query("rdp_training", O.sql("SELECT '>S' || taxid || ' 1_root;' || array_to_string(list_transform(ids[3:8], lambda x: x || '_n' || x), ';') || chr(10) || substring('ACGT', taxid % 4 + 1, 1) AS record, 'S' || taxid AS id FROM lin " + CELLULAR_SPECIES, *O.TREE))
def rdp_training(spark, sf):
    return G.training_records(*_sequences(spark, sf))


@query("rdp_training_taxa", O.sql("""SELECT taxid, taxid || '*' || taxid || '_n' || taxid || '*' || CASE WHEN rank = 1 THEN 1 ELSE parent END || '*' || CASE rank WHEN 1 THEN '1*superkingdom' WHEN 5 THEN '2*phylum' WHEN 8 THEN '3*class' WHEN 14 THEN '4*order' WHEN 19 THEN '5*family' ELSE '6*genus' END AS line
 FROM nodes WHERE rank IN (1, 5, 8, 14, 19, 23) AND taxid IN (SELECT unnest(ids) FROM lin """ + CELLULAR_SPECIES + ") UNION ALL SELECT 1, '1*1_root*0*0*norank'", *O.TREE))
def rdp_training_taxa(spark, sf):
    return G.training_taxa(*_sequences(spark, sf))


@query("banded_nw")
def banded_nw(spark, sf):
    """Each benchmark text against itself less some letters."""
    score = formats.banded_score({a + b: 4 if a == b else -1 for a in Q.AMINO for b in Q.AMINO})
    s = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUXZ", "ACDEFG")
    rows = S.table(spark, sf, "benchmark").select("item_id", s.alias("s"))
    return rows.select("item_id", score("s", F.regexp_replace("s", "(?<=AN)D", "")).alias("score"))


def _letters(spark, sf):
    s = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUXZ", "ACDEFG")
    return S.table(spark, sf, "benchmark").select("item_id", (F.floor(F.col("item_id") / 2) % 4).alias("family"), F.concat(F.repeat(F.lit("-"), (F.col("item_id") % 3).cast("int")), s).alias("aligned"))


@query("classify_hmm")
def classify_hmm(spark, sf):
    """Texts of even items as fragments, of odd ones as their families' members."""
    rows = _letters(spark, sf)
    members = T.with_path(rows.where("item_id % 2 = 1").select("family", F.col("item_id").alias("member"), (1000000 + F.col("item_id")).cast("int").alias("taxid"), "aligned"), tree(spark, sf))
    return modes.family(rows.where("item_id % 2 = 0").select(F.col("item_id").alias("query"), "family", "aligned"), members, rule_matrix(), 0)


@query("classify_16s")
def classify_16s(spark, sf):
    """Orders as fragments, suppliers as subjects whose rows are alike within a nation."""
    letters = lambda c: F.translate(F.md5(c.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    nation, own = letters(F.col("s_nationkey") % 5), letters(F.col("s_suppkey"))
    subjects = S.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), (1000000 + F.col("s_suppkey")).cast("int").alias("taxid"), (F.col("s_nationkey") % 2).alias("kingdom"), (F.col("s_suppkey") % 3).cast("int").alias("offset"), F.concat(nation, nation, F.substring(own, 1, 8), nation).alias("aligned"))
    r = S.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "query")
    order = Window.partitionBy("query").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_suppkey", "l_partkey")
    start = 1 + F.col("l_quantity").cast("int") % 10
    hits = r.select("query", F.row_number().over(order).alias("ord"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit(95).alias("identity"), F.lit(41).alias("aln_len"), (F.col("l_partkey") % 3).cast("int").alias("mismatches"), F.lit(0).alias("openings"), start.alias("s_start"), (start + 40).alias("s_end"), F.col("l_extendedprice").alias("bitscore"))
    return modes.ribosomal(hits, T.with_path(subjects, tree(spark, sf)))
