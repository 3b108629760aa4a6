"""Queries of profiles and of merging results."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.operators import joins as J
from rankloom.operators import profile as P
from rankloom.operators import taxonomy as T
from rankloom.plans import oracle as O
from rankloom.plans.registry import query
from rankloom.plans.taxonomy import LCA, hits_with_path, numbered_tree, tree
from rankloom.sources import parsers
from rankloom.sources import sinks as K
from rankloom.sources import tables as S

NAME = """CASE rk WHEN 1 THEN 'superkingdom' WHEN 5 THEN 'phylum' WHEN 8 THEN 'class' WHEN 14 THEN 'order' WHEN 19 THEN 'family' WHEN 23 THEN 'genus' WHEN 27 THEN 'species' END"""
READS = """, smp AS (SELECT o_orderkey AS query, o_orderpriority AS sample FROM orders),
rd AS (SELECT lca.query, sample, lca, ids, rks FROM lca JOIN smp USING (query) LEFT JOIN lin ON lca = lin.taxid),
ent AS (SELECT query, sample, 'superkingdom' AS rank, CASE WHEN lca < 1 OR ids IS NULL THEN 'Unknown' ELSE 'Non-cellular' END AS taxon FROM rd WHERE lca < 1 OR ids IS NULL OR NOT list_contains(ids, 131567)
 UNION ALL SELECT query, sample, """ + NAME + """, coalesce(nm.name, node::VARCHAR) FROM (SELECT query, sample, unnest(ids) AS node, unnest(rks) AS rk FROM rd WHERE lca >= 1 AND list_contains(ids, 131567)) LEFT JOIN (SELECT * FROM names WHERE class = 'scientific name') nm ON nm.taxid = node WHERE rk IN (1, 5, 8, 14, 19, 23, 27)),
prof AS (SELECT sample, rank, taxon, count(*) AS n FROM ent GROUP BY ALL)
"""
BASE = (*O.ALL, LCA, READS)


def scientific(spark, sf):
    return S.names(spark, sf).where("class = 'scientific name'")


def reads(spark, sf):
    """query, taxid, path and sample of every read, by the common ancestor of its hits."""
    lca = T.lca_by_number(S.hits(spark, sf), numbered_tree(spark, sf)).withColumnRenamed("lca", "taxid")
    sample = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderpriority").alias("sample"))
    return T.with_path(lca, tree(spark, sf)).join(sample, "query")


def counts(spark, sf):
    rows = P.read_ranks(reads(spark, sf), scientific(spark, sf), P.DEFAULT_RANKS, "sample")
    return rows.groupBy("sample", "rank", "taxon").agg(F.count(F.lit(1)).alias("n"))


@query("taxonomic_profile", O.sql("SELECT rank, taxon, count(*) AS n FROM ent GROUP BY ALL", *BASE))
def taxonomic_profile(spark, sf):
    lca = T.lca_by_number(S.hits(spark, sf), numbered_tree(spark, sf)).withColumnRenamed("lca", "taxid")
    return P.taxonomic_profile(T.with_path(lca, tree(spark, sf)), scientific(spark, sf))


CUT = """, sh AS (SELECT *, n / sum(n) OVER (PARTITION BY sample, rank) AS s FROM prof), mx AS (SELECT *, max(s) OVER (PARTITION BY rank, taxon) AS m FROM sh)"""


@query("comparative_profile", O.sql("SELECT sample, rank, taxon, n, n / sum(n) OVER (PARTITION BY sample, rank) AS share FROM mx WHERE m > 0.01", *BASE, CUT))
def comparative_profile(spark, sf):
    return P.comparative_profile(counts(spark, sf), 0.01)


@query("comparative_other", O.sql("SELECT sample, rank, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (m > 0.01), 0)::BIGINT AS kept_total, 1 - coalesce(sum(n) FILTER (m > 0.01), 0) / sum(n)::DOUBLE AS other FROM mx GROUP BY sample, rank", *BASE, CUT))
def comparative_other(spark, sf):
    return P.comparative_other(counts(spark, sf), 0.01)


SAMPLES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WIDE = ", ".join(f"coalesce(max({{0}}) FILTER (sample = '{s}'), 0)::{{1}} AS \"{s}\"" for s in SAMPLES)


@query("comparative_wide", O.sql("SELECT rank, taxon, " + WIDE.format("share", "DOUBLE") + " FROM (SELECT *, n / sum(n) OVER (PARTITION BY sample, rank) AS share FROM mx WHERE m > 0.01) GROUP BY rank, taxon", *BASE, CUT))
def comparative_wide(spark, sf):
    """One column a sample."""
    return P.comparative_wide(counts(spark, sf), SAMPLES, 0.01)


@query("comparative_filtered", O.sql("SELECT rank, " + ", ".join(f"""coalesce(max(away) FILTER (sample = '{s}'), 0)::BIGINT AS "{s}", max(part) FILTER (sample = '{s}')::DOUBLE AS "{s}_share\"""" for s in SAMPLES) + """
 FROM (SELECT *, away / nullif(stay, 0)::DOUBLE AS part FROM (SELECT sample, rank, coalesce(sum(n) FILTER (m <= 0.01), 0) AS away, coalesce(sum(n) FILTER (m > 0.01), 0) AS stay FROM mx GROUP BY sample, rank)) GROUP BY rank""", *BASE, CUT))
def comparative_filtered(spark, sf):
    """What the cutoff takes away of each sample, and its share of what stays."""
    return P.filtered_away(counts(spark, sf), SAMPLES, 0.01)


@query("sink_comparative", O.sql("SELECT rank || chr(9) || '\"' || taxon || '\"' || chr(9) || concat_ws(chr(9), " + ", ".join(f'"{s}"' for s in SAMPLES) + ") AS line FROM (SELECT rank, taxon, " + WIDE.format("n", "BIGINT") + " FROM mx WHERE m > 0.01 GROUP BY rank, taxon)", *BASE, CUT))
def sink_comparative(spark, sf):
    """Lines of the wide profile's counts."""
    return K.comparative_lines(P.comparative_wide(counts(spark, sf), SAMPLES, 0.01, absolute=True), SAMPLES, absolute=True)


@query("sink_profile", O.sql("SELECT rank, taxon, count(*) AS n FROM ent GROUP BY ALL", *BASE))
def sink_profile(spark, sf):
    """The lines of a profile, read back."""
    return parsers.profile(K.profile_lines(taxonomic_profile(spark, sf)).withColumnRenamed("line", "value"))


@query("topk_taxa_per_rank", O.sql("SELECT rank, taxon, n, place FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY n DESC, taxon) AS place FROM (SELECT rank, taxon, count(*) AS n FROM ent GROUP BY ALL)) WHERE place <= 10", *BASE))
def topk_taxa_per_rank(spark, sf):
    return P.top_per_rank(taxonomic_profile(spark, sf), 10).withColumn("place", F.col("place").cast("long"))


@query("order_by_sample", O.sql("SELECT rank, taxon, n, row_number() OVER (PARTITION BY rank ORDER BY n DESC, taxon) AS place FROM (SELECT rank, taxon, coalesce(sum(n) FILTER (sample = '2-HIGH'), 0)::BIGINT AS n FROM prof GROUP BY ALL)", *BASE))
def order_by_sample(spark, sf):
    return P.by_sample(counts(spark, sf), "2-HIGH").withColumn("place", F.col("place").cast("long"))


@query("taxa_union", O.sql("SELECT DISTINCT rank, taxon FROM prof", *BASE))
def taxa_union(spark, sf):
    return counts(spark, sf).select("rank", "taxon").distinct()


@query("profile_evalue_cutoff", O.sql("SELECT l_orderkey AS query, count(*) FILTER (round(l_discount * 100) <= 5) AS kept, count(*) FILTER (round(l_discount * 100) > 5) AS unknown FROM lineitem GROUP BY 1"))
def profile_evalue_cutoff(spark, sf):
    ev = F.round(F.col("l_discount") * 100)
    return S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query")).agg(F.count_if(ev <= 5).alias("kept"), F.count_if(ev > 5).alias("unknown"))


TEXT_EVALUE = "CASE {0} % 9 WHEN 0 THEN '-' ELSE '1e-' || {0} % 9 END"


@query("taxonomic_profile_cutoff", O.sql(f", cut AS (SELECT query, {TEXT_EVALUE.format('query')} AS e FROM rd) SELECT rank, taxon, sum(n)::BIGINT AS n FROM (SELECT rank, taxon, count(*) AS n FROM ent JOIN cut USING (query) WHERE coalesce(try_cast(e AS DOUBLE), 0) <= 1e-3 GROUP BY ALL UNION ALL SELECT 'superkingdom', 'Unknown', count(*) FROM cut WHERE try_cast(e AS DOUBLE) > 1e-3) WHERE n > 0 GROUP BY ALL", *BASE))
def taxonomic_profile_cutoff(spark, sf):
    """E-values by order, some of them not known."""
    q = F.col("query") % 9
    rows = reads(spark, sf).withColumn("evalue", F.when(q == 0, "-").otherwise(F.concat(F.lit("1e-"), q.cast("string"))))
    return P.taxonomic_profile(P.unknown_above(rows, 1e-3), scientific(spark, sf))


@query("functional_profile_cutoff", f"SELECT go_id, upper(go_id) AS term, length(go_id)::VARCHAR AS category, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS go_id FROM part WHERE coalesce(try_cast({TEXT_EVALUE.format('p_partkey')} AS DOUBLE), 0) <= 1e-3) GROUP BY go_id")
def functional_profile_cutoff(spark, sf):
    k = F.col("p_partkey") % 9
    rows = S.table(spark, sf, "part").select(F.split("p_name", " ").alias("go"), F.when(k == 0, "-").otherwise(F.concat(F.lit("1e-"), k.cast("string"))).alias("evalue"))
    return P.functional_profile(P.within(rows, 1e-3), terms(spark, sf))


GO = "SELECT unnest(string_split(p_name, ' ')) AS go_id FROM part"


def terms(spark, sf):
    ids = S.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("go_id")).distinct()
    return ids.select("go_id", F.upper("go_id").alias("term"), F.length("go_id").cast("string").alias("category"))


@query("functional_profile", f"SELECT go_id, upper(go_id) AS term, length(go_id)::VARCHAR AS category, count(*) AS n FROM ({GO}) GROUP BY go_id")
def functional_profile(spark, sf):
    return P.functional_profile(S.table(spark, sf, "part").select(F.split("p_name", " ").alias("go")), terms(spark, sf))


@query("topk_go", f"SELECT go_id, n FROM (SELECT go_id, count(*) AS n FROM ({GO}) GROUP BY go_id) ORDER BY n DESC, go_id LIMIT 40")
def topk_go(spark, sf):
    return functional_profile(spark, sf).select("go_id", "n").orderBy(F.desc("n"), "go_id").limit(40)


@query("go_list", "SELECT p_brand AS family, string_agg(DISTINCT t, ',' ORDER BY t) AS go FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS t FROM part) GROUP BY p_brand")
def go_list(spark, sf):
    rows = S.table(spark, sf, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("t"))
    return rows.groupBy(F.col("p_brand").alias("family")).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("go"))


# Result rows of three files: each order in up to three of them, its e-value by its key.
FILES = """fl AS (SELECT o_orderkey::VARCHAR || '_+1_-2' AS name, 1 AS priority, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE (1 + o_orderkey % 7)::VARCHAR END AS evalue, o_custkey AS taxid FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey::VARCHAR, 2, (1 + o_orderkey % 11)::VARCHAR, o_custkey + 1 FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey::VARCHAR, 3, CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE (1 + o_orderkey % 13)::VARCHAR END, o_custkey + 2 FROM orders)"""


def result_files(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    text = lambda m: (1 + F.col("k") % m).cast("string")
    a = o.where("k % 2 = 0").select(F.concat(F.col("k").cast("string"), F.lit("_+1_-2")).alias("name"), F.lit(1).alias("priority"), F.when(F.col("k") % 5 == 0, "-").otherwise(text(7)).alias("evalue"), F.col("c").alias("taxid"))
    b = o.where("k % 3 = 0").select(F.col("k").cast("string").alias("name"), F.lit(2).alias("priority"), text(11).alias("evalue"), (F.col("c") + 1).alias("taxid"))
    c = o.select(F.col("k").cast("string").alias("name"), F.lit(3).alias("priority"), F.when(F.col("k") % 4 == 0, "0").otherwise(text(13)).alias("evalue"), (F.col("c") + 2).alias("taxid"))
    return a.unionByName(b).unionByName(c).withColumn("read", P.read_of(F.col("name")))


@query("merge_tax_files", f"WITH {FILES} SELECT name, priority, evalue, taxid FROM fl")
def merge_tax_files(spark, sf):
    return result_files(spark, sf).select("name", "priority", "evalue", "taxid")


@query("read_id_strip", f"WITH {FILES} SELECT name, regexp_replace(name, '_[+-]?[0-9]_[+-]?[0-9]$', '') AS read FROM fl")
def read_id_strip(spark, sf):
    return result_files(spark, sf).select("name", "read")


@query("combine_first_wins", f"WITH {FILES} SELECT read, min_by(taxid, priority) AS taxid FROM (SELECT *, regexp_replace(name, '_[+-]?[0-9]_[+-]?[0-9]$', '') AS read FROM fl) GROUP BY read")
def combine_first_wins(spark, sf):
    return P.first_file_wins(result_files(spark, sf).select("read", "priority", "taxid"))


@query("combine_by_evalue", f"WITH {FILES} SELECT read, min_by(evalue, (e, priority)) AS evalue, min_by(taxid, (e, priority)) AS taxid FROM (SELECT *, regexp_replace(name, '_[+-]?[0-9]_[+-]?[0-9]$', '') AS read, try_cast(evalue AS DOUBLE) AS e FROM fl) WHERE e > 0 AND e < 100000 GROUP BY read")
def combine_by_evalue(spark, sf):
    return P.best_evalue_wins(result_files(spark, sf).select("read", "priority", "taxid", "evalue"), file="priority").select("read", "evalue", "taxid")


@query("semi_anti_incomplete_jobs", "SELECT c_custkey AS job FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti_incomplete_jobs(spark, sf):
    done = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return S.table(spark, sf, "customer").join(done, "c_custkey", "left_anti").select(F.col("c_custkey").alias("job"))


@query("merge_hit_counts", "SELECT a.q AS query, a.n AS n_first, b.n AS n_second, (a.n > b.n) AS more FROM (SELECT l_orderkey AS q, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) a JOIN (SELECT l_orderkey AS q, count(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) b ON a.q = b.q")
def merge_hit_counts(spark, sf):
    first = F.col("l_linenumber") <= 3
    rows = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query")).agg(F.count_if(first).alias("n_first"), F.count_if(~first).alias("n_second"))
    return rows.where("n_first > 0 and n_second > 0").withColumn("more", F.col("n_first") > F.col("n_second"))


@query("query_count_check", "SELECT chunk, count(*) AS n, count(*) <> 100 AS wrong FROM (SELECT o_orderkey // 100 AS chunk FROM orders) GROUP BY chunk")
def query_count_check(spark, sf):
    rows = S.table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 100").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("wrong", F.col("n") != 100)


@query("identifier_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def identifier_uniqueness(spark, sf):
    return J.repeated(S.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
