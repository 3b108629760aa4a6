"""Queries of the taxonomy and of the filters over hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.operators import hits as H
from rankloom.operators import taxonomy as T
from rankloom.plans import oracle as O
from rankloom.plans.registry import query
from rankloom.sources import tables as S


_TREES: dict = {}


def tree(spark, sf):
    """The lineages of sf's taxonomy, worked out once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TREES:
        _TREES[key] = T.lineages(S.nodes(spark, sf))
    return _TREES[key]


def numbered_tree(spark, sf):
    """The same with the numbers of a walk over the tree."""
    key = (spark.sparkContext.applicationId, sf, "numbered")
    if key not in _TREES:
        _TREES[key] = T.numbered(tree(spark, sf))
    return _TREES[key]


@query("tree_numbers", O.sql("SELECT a.taxid, row_number() OVER (ORDER BY a.ids) AS enter, row_number() OVER (ORDER BY a.ids) + n - 1 AS exit FROM lin a JOIN (SELECT node, count(*) AS n FROM (SELECT unnest(ids) AS node FROM lin) GROUP BY node) s ON s.node = a.taxid", *O.TREE))
def tree_numbers(spark, sf):
    return numbered_tree(spark, sf).select("taxid", "enter", "exit")


def hits_with_path(spark, sf):
    return T.with_path(S.hits(spark, sf), tree(spark, sf))


@query("lineage", O.sql("SELECT taxid, len(ids) AS depth, array_to_string(ids, '!') AS path FROM lin", *O.TREE))
def lineage(spark, sf):
    return tree(spark, sf).select("taxid", F.size("path").cast("long").alias("depth"), F.array_join(ranks.taxids(F.col("path")).cast("array<string>"), "!").alias("path"))


PAIRS = """ SELECT a.taxid AS a, b.taxid AS b, a.ids AS ia, b.ids AS ib FROM lin a JOIN lin b
  ON a.taxid >= 1000000 AND b.taxid = 1000000 + ((a.taxid - 1000000) * 7 + 3) % (SELECT count(*) FROM customer)"""


def pairs(spark, sf):
    rows, n = tree(spark, sf), S.table(spark, sf, "customer").count()
    a = rows.where("taxid >= 1000000").select(F.col("taxid").alias("a"), ranks.taxids(F.col("path")).alias("ia"))
    a = a.withColumn("b", (1000000 + ((F.col("a") - 1000000) * 7 + 3) % n).cast("int"))
    return a.join(rows.select(F.col("taxid").alias("b"), ranks.taxids(F.col("path")).alias("ib")), "b")


@query("lca_pair", O.sql(f"SELECT a, b, coalesce(ia[len(list_intersect(ia, ib))], 0) AS lca FROM ({PAIRS})", *O.TREE))
def lca_pair(spark, sf):
    return pairs(spark, sf).select("a", "b", ranks.lca(F.col("ia"), F.col("ib")).alias("lca"))


@query("lcp_length", O.sql(f"SELECT a, b, len(list_intersect(ia, ib)) AS n FROM ({PAIRS})", *O.TREE))
def lcp_length(spark, sf):
    return pairs(spark, sf).select("a", "b", ranks.common_length(F.col("ia"), F.col("ib")).cast("long").alias("n"))


@query("lowest_rank", O.sql("SELECT taxid, coalesce(list_filter(rks, lambda r: r <> 0)[-1], 0) AS lowest FROM lin", *O.TREE))
def lowest_rank(spark, sf):
    return tree(spark, sf).select("taxid", ranks.lowest_rank(F.col("path")).alias("lowest"))


AT = """SELECT taxid, t.target, CASE WHEN len(hi) = 0 THEN 0 WHEN hi[-1] = t.target THEN ids[list_position(rks, t.target)]
    ELSE coalesce(ids[list_position(rks, lo[1])], 0) END AS taxon
  FROM (SELECT taxid, ids, rks, target, list_filter(rks, lambda r: r <> 0 AND r <= target) AS hi, list_filter(rks, lambda r: r > target) AS lo
        FROM lin, (VALUES (1), (5), (7), (10), (14), (19), (23)) v(target)) t"""


@query("taxon_at_rank", O.sql(AT, *O.TREE))
def taxon_at_rank(spark, sf):
    rows = tree(spark, sf).withColumn("target", F.explode(F.array(*[F.lit(x) for x in (1, 5, 7, 10, 14, 19, 23)])))
    return rows.select("taxid", "target", ranks.taxon_at_rank(F.col("path"), F.col("target")).alias("taxon"))


RED = """SELECT taxid, target, coalesce(ids[list_position(rks, list_max(list_filter(rks, lambda r: r > 0 AND r <= target)))], -1) AS reduced
  FROM lin, (VALUES (0), (1), (6), (14), (20), (27)) v(target)"""


@query("reduce_by_rank", O.sql(RED, *O.TREE))
def reduce_by_rank(spark, sf):
    rows = tree(spark, sf).withColumn("target", F.explode(F.array(*[F.lit(x) for x in (0, 1, 6, 14, 20, 27)])))
    return rows.select("taxid", "target", ranks.reduce_by_rank(F.col("path"), F.col("target")).alias("reduced"))


SIMPLE = "CASE WHEN rank >= 27 THEN 0 WHEN rank >= 23 THEN 1 WHEN rank >= 19 THEN 2 WHEN rank >= 14 THEN 3 WHEN rank >= 8 THEN 4 WHEN rank >= 5 THEN 5 WHEN rank >= 1 THEN 6 ELSE 7 END"


@query("simple_rank", O.sql(f"SELECT taxid, {SIMPLE} AS simple FROM nodes", O.NODES))
def simple_rank(spark, sf):
    return S.nodes(spark, sf).select("taxid", ranks.simple_rank(F.col("rank")).alias("simple"))


LCA = """, use AS (SELECT query, ids, rks, ids[2] IN (28384, 12908) AS skip FROM ph),
tot AS (SELECT query, count(*) FILTER (NOT coalesce(skip, false)) AS n FROM use GROUP BY query),
anc AS (SELECT query, unnest(ids) AS node, generate_subscripts(ids, 1) AS pos FROM use WHERE NOT coalesce(skip, false)),
com AS (SELECT a.query, a.node, max(pos) AS pos FROM anc a JOIN tot USING (query) GROUP BY a.query, a.node, n HAVING count(*) = n),
lca AS (SELECT tot.query, coalesce(max_by(node, pos), -1) AS lca FROM tot LEFT JOIN com USING (query) GROUP BY tot.query)
"""
# The same where some hits have no taxon: they land on the root.
LCA_ROOT = LCA.replace("SELECT query, ids, rks, ids[2]", "SELECT query, CASE WHEN part % 97 = 0 THEN [1] ELSE ids END AS ids, rks, part % 97 <> 0 AND ids[2]")


@query("lca_multi", O.sql("SELECT query, lca FROM lca", *O.TREE_HITS, LCA_ROOT))
def lca_multi(spark, sf):
    return T.lca_by_number(hits_some_without(spark, sf), numbered_tree(spark, sf))


def hits_some_without(spark, sf):
    return S.hits(spark, sf).withColumn("taxid", F.when(F.col("part") % 97 == 0, 0).otherwise(F.col("taxid")))


@query("taxon_path_string", O.sql("""SELECT l.taxid, string_agg(coalesce(lower(nm.name), 'unknown'), '!' ORDER BY pos) AS path
  FROM (SELECT taxid, unnest(ids) AS node, generate_subscripts(ids, 1) AS pos FROM lin) l LEFT JOIN (SELECT * FROM names WHERE class = 'scientific name') nm ON nm.taxid = node GROUP BY l.taxid""", *O.TREE_NAMES))
def taxon_path_string(spark, sf):
    known = S.names(spark, sf).where("class = 'scientific name'").select(F.col("taxid").alias("ancestor"), F.lower("name").alias("name"))
    rows = T.ancestors(tree(spark, sf), "taxid").join(known, "ancestor", "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("unknown")).alias("name"))))
    return rows.groupBy("taxid").agg(F.array_join(F.transform(listed, lambda s: s["name"]), "!").alias("path"))


@query("ranks_of_taxon", O.sql("SELECT taxid, ids[list_position(rks, 5)] AS phylum, ids[list_position(rks, 14)] AS ord, ids[list_position(rks, 23)] AS genus, len(list_filter(rks, lambda r: r <> 0)) AS n FROM lin", *O.TREE))
def ranks_of_taxon(spark, sf):
    by = F.col("by_rank")
    return T.ranks_of(tree(spark, sf)).select("taxid", by["phylum"].alias("phylum"), by["order"].alias("ord"), by["genus"].alias("genus"), F.size(by).cast("long").alias("n"))


WHILE = "SELECT query, ord FROM (SELECT *, max(CASE WHEN {} THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY ord) AS f FROM (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM hits)) WHERE f = 0"


@query("filter_evalue", O.sql(WHILE.format("ev > 6"), O.NODES, O.HITS))
def filter_evalue(spark, sf):
    return H.filter_evalue(S.hits(spark, sf), 6).select("query", F.col("ord").cast("long").alias("ord"))


@query("filter_bitscore", O.sql(WHILE.format("score < 2000000"), O.NODES, O.HITS))
def filter_bitscore(spark, sf):
    return H.filter_bitscore(S.hits(spark, sf), 2000000).select("query", F.col("ord").cast("long").alias("ord"))


@query("filter_alignment_length", O.sql("SELECT query, ord FROM hits WHERE aln_len >= 25", O.NODES, O.HITS))
def filter_alignment_length(spark, sf):
    return H.filter_alignment_length(S.hits(spark, sf), 25).select("query", F.col("ord").cast("long").alias("ord"))


TOP = """SELECT query, ord, max(f) OVER (PARTITION BY query) = 0 AS exhausted FROM (SELECT query, ord, CASE WHEN score < (1 - 0.5::DOUBLE) * max(score) OVER (PARTITION BY query) THEN 1 ELSE 0 END AS f FROM hits)
 QUALIFY max(f) OVER (PARTITION BY query ORDER BY ord) = 0"""


@query("filter_top_percent", O.sql(TOP, O.NODES, O.HITS))
def filter_top_percent(spark, sf):
    return H.filter_top_percent(S.hits(spark, sf), 0.5).select("query", F.col("ord").cast("long").alias("ord"), "exhausted")


@query("filter_superkingdom", O.sql("SELECT query, ord FROM ph WHERE ids[1] = 1 AND ids[3] IN (2157, 2, 2759, 12884, 10239)", *O.TREE_HITS))
def filter_superkingdom(spark, sf):
    return H.filter_superkingdom(hits_with_path(spark, sf)).select("query", F.col("ord").cast("long").alias("ord"))


ALN = "aln_len * 15 AS q_len, 40 + part % 60 AS identity, supp % 3 AS gaps, part % 9 AS d"
RANK_FOR = """CASE WHEN q_len >= 550 THEN CASE WHEN identity >= 90 AND gaps = 0 AND d = 0 THEN 27 WHEN identity >= 90 THEN 23 WHEN identity >= 75 AND d <= 2 THEN 23 WHEN identity >= 75 THEN 19 WHEN identity >= 60 THEN 8 WHEN identity >= 45 THEN 5 END
 WHEN q_len >= 150 THEN CASE WHEN identity >= 65 AND d <= 6 THEN 23 WHEN identity >= 60 THEN 19 WHEN identity >= 55 THEN 14 WHEN identity >= 50 THEN 8 WHEN q_len >= 350 AND identity >= 35 THEN 5 WHEN identity >= 45 THEN 5 END
 ELSE CASE WHEN identity >= 65 AND d <= 1 THEN 23 WHEN identity >= 65 THEN 19 WHEN identity >= 50 THEN 5 END END"""


def aligned(spark, sf):
    rows = hits_with_path(spark, sf).withColumns({"q_len": F.col("aln_len") * 15, "identity": 40 + F.col("part") % 60, "gaps": F.col("supp") % 3, "identities": F.lit(0), "positives": F.col("part") % 9})
    return rows


@query("reduce_taxon", O.sql(f"SELECT query, ord, {RANK_FOR} AS rank FROM (SELECT query, ord, {ALN} FROM hits)", O.NODES, O.HITS))
def reduce_taxon(spark, sf):
    rank = ranks.least_rank_for(F.col("q_len"), F.col("identity"), F.col("gaps"), F.col("positives") - F.col("identities"))
    rows = S.hits(spark, sf).withColumns({"q_len": F.col("aln_len") * 15, "identity": 40 + F.col("part") % 60, "gaps": F.col("supp") % 3, "identities": F.lit(0), "positives": F.col("part") % 9})
    return rows.select("query", F.col("ord").cast("long").alias("ord"), rank.alias("rank"))


@query("filter_reduce_taxa", O.sql(f"SELECT query, ord, coalesce(ids[list_position(rks, list_max(list_filter(rks, lambda r: r > 0 AND r <= target)))], -1) AS reduced FROM (SELECT query, ord, ids, rks, {RANK_FOR} AS target FROM (SELECT query, ord, ids, rks, {ALN} FROM ph))", *O.TREE_HITS))
def filter_reduce_taxa(spark, sf):
    return H.filter_reduced_taxa(aligned(spark, sf)).select("query", F.col("ord").cast("long").alias("ord"), "reduced")


MATCH = """, flags AS (SELECT query, ord, ev, aln_len, ids, CASE WHEN ev > {0} OR score < {1} OR score < (1 - 0.5::DOUBLE) * max(score) OVER (PARTITION BY query) THEN 1 ELSE 0 END AS f FROM ph),
kept AS (SELECT query, ord, ev, CASE WHEN max(f) OVER (PARTITION BY query ORDER BY ord) = 0 AND aln_len >= {2} AND ids[1] = 1 AND ids[3] IN (2157, 2, 2759, 12884, 10239) THEN 1 ELSE 0 END AS k FROM flags),
cnt AS (SELECT query, count(*) AS n_hits, sum(k)::BIGINT AS n_left, min_by(ev, ord) FILTER (k = 1) AS first FROM kept GROUP BY query)
SELECT o_orderkey AS query, coalesce(n_hits, 0) AS n_hits, coalesce(n_left, 0) AS n_left, coalesce(first::VARCHAR, '-') AS evalue, CASE WHEN coalesce(n_hits, 0) = 0 THEN 'no_hits' WHEN n_left = 0 THEN 'no_hits2' ELSE 'hits' END AS state
FROM orders LEFT JOIN cnt ON o_orderkey = query"""


def matching(spark, sf, match_type):
    queries = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"))
    limits = H.limits_for(match_type, (8, 1000000, 10), (6, 2000000, 20), (1, 9000000, 40))
    return H.matching_queries(queries, hits_with_path(spark, sf), *limits, 0.5)


@query("filter_matching_query", O.sql(MATCH.format(8, 1000000, 10), *O.TREE_HITS))
def filter_matching_query(spark, sf):
    return matching(spark, sf, "BLASTX")


@query("filter_matching_query_n", O.sql(MATCH.format(6, 2000000, 20), *O.TREE_HITS))
def filter_matching_query_n(spark, sf):
    """Nucleotide hits take the limits meant for proteins."""
    return matching(spark, sf, "BLASTN")


@query("filter_matching_query_p", O.sql(MATCH.format("1e300", 0, 0), *O.TREE_HITS))
def filter_matching_query_p(spark, sf):
    """Protein hits take no limits."""
    return matching(spark, sf, "BLASTP")


@query("order_hits", O.sql("SELECT query, ord, row_number() OVER (PARTITION BY query ORDER BY 40 + part % 60 DESC, ord) AS by_identity, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS by_bitscore, row_number() OVER (PARTITION BY query ORDER BY ev, ord) AS by_evalue FROM hits", O.NODES, O.HITS))
def order_hits(spark, sf):
    rows = S.hits(spark, sf).withColumn("identity", 40 + F.col("part") % 60)
    for by in ("identity", "bitscore", "evalue"):
        rows = H.ranked(rows, by).withColumn(f"by_{by}", F.col("place").cast("long"))
    return rows.select("query", F.col("ord").cast("long").alias("ord"), "by_identity", "by_bitscore", "by_evalue")


@query("ordered_output", O.sql("SELECT query, min(taxid) AS taxid FROM hits GROUP BY query ORDER BY query", O.NODES, O.HITS))
def ordered_output(spark, sf):
    """Results in order of the query: a sort by ranges."""
    return S.hits(spark, sf).groupBy("query").agg(F.min("taxid").alias("taxid")).orderBy("query")


@query("first_unmasked_hit", O.sql("SELECT query, min(ord) AS ord, min_by(taxid, ord) AS taxid FROM hits WHERE aln_len >= 25 GROUP BY query", O.NODES, O.HITS))
def first_unmasked_hit(spark, sf):
    rows = H.filter_alignment_length(S.hits(spark, sf), 25)
    return H.first_hit(rows.withColumn("o", F.col("ord").cast("long")), "o", "taxid").select("query", F.col("o").alias("ord"), "taxid")


@query("excluded_taxa", O.sql("""SELECT taxid FROM lin WHERE len(list_intersect(ids, (SELECT list(DISTINCT ids[list_position(rks, 19)]) FROM lin WHERE taxid IN (1000003, 1000010, 1000017)))) = 0""", *O.TREE))
def excluded_taxa(spark, sf):
    rows = tree(spark, sf)
    return T.excluded(rows, [1000003, 1000010, 1000017], rows, 19).select("taxid")


@query("specific_taxon", O.sql("SELECT taxid FROM lin WHERE rank >= 27 AND list_contains(rks, 5) AND list_contains(rks, 23) AND ids[list_position(rks, 23)] % 11 <> 0", *O.TREE))
def specific_taxon(spark, sf):
    """Every eleventh genus is called environmental samples here."""
    names = tree(spark, sf).where("rank = 23").select("taxid", F.when(F.col("taxid") % 11 == 0, "environmental samples").otherwise("genus").alias("name"))
    return T.named_genus(tree(spark, sf), names).where(T.specific(F.col("path"), F.col("genus_name"))).select("taxid")


@query("collapse_consecutive", O.sql("SELECT query, ord, taxid FROM (SELECT *, lag(taxid) OVER (PARTITION BY query ORDER BY ord) AS p FROM hits) WHERE p IS DISTINCT FROM taxid", O.NODES, O.HITS))
def collapse_consecutive(spark, sf):
    return H.collapse_consecutive(S.hits(spark, sf), "taxid").select("query", F.col("ord").cast("long").alias("ord"), "taxid")


@query("sort_hsps", O.sql("SELECT query, ord, taxid, row_number() OVER (PARTITION BY query, taxid ORDER BY score DESC, ord) AS rank_in_hit FROM hits", O.NODES, O.HITS))
def sort_hsps(spark, sf):
    return H.sorted_hsps(S.hits(spark, sf)).select("query", F.col("ord").cast("long").alias("ord"), "taxid", F.col("rank_in_hit").cast("long").alias("rank_in_hit"))


@query("reads_per_query", O.sql("SELECT query, count(*) AS n, count(*) FILTER (aln_len >= 25) AS n_left FROM hits GROUP BY query", O.NODES, O.HITS))
def reads_per_query(spark, sf):
    return S.hits(spark, sf).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("aln_len") >= 25).alias("n_left"))


@query("phylum_counts", O.sql("SELECT ids[list_position(rks, 5)] AS phylum, count(*) AS n FROM lin WHERE list_contains(rks, 5) GROUP BY 1", *O.TREE))
def phylum_counts(spark, sf):
    rows = tree(spark, sf).select(F.get(F.filter("path", lambda s: s["rank"] == 5), F.lit(0))["taxid"].alias("phylum"))
    return rows.where("phylum is not null").groupBy("phylum").agg(F.count(F.lit(1)).alias("n"))


@query("used_taxa", O.sql("SELECT DISTINCT node FROM (SELECT unnest(ids) AS node, unnest(rks) AS rk FROM ph) WHERE rk IN (1, 5, 8, 14, 19, 23)", *O.TREE_HITS))
def used_taxa(spark, sf):
    used = S.hits(spark, sf).select("taxid").distinct()
    rows = T.ancestors(T.with_path(used, tree(spark, sf)), "taxid")
    return rows.where(F.col("ancestor_rank").isin(1, 5, 8, 14, 19, 23)).select(F.col("ancestor").alias("node")).distinct()
