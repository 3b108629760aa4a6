"""Queries of classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.operators import classify as C
from rankloom.operators import hits as H
from rankloom.operators import reads as R
from rankloom.operators import taxonomy as T
from rankloom.plans import oracle as O
from rankloom.plans.registry import query
from rankloom.plans.taxonomy import ALN, LCA_ROOT, RANK_FOR, SIMPLE, aligned, hits_some_without, hits_with_path, numbered_tree, tree
from rankloom.sources import tables as S

# The best hit plays the query itself; its own score times 70 to 100 per cent is the query's score.
PAIRS = """
, best AS (SELECT query, max_by(ids, (score, -ord)) AS bids, max_by(rks, (score, -ord)) AS brks, max(score) AS self, max_by(ord, (score, -ord)) AS bord,
    max(score) * (70 + query % 31) / 100.0::DOUBLE AS q, count(*) AS n FROM {src} GROUP BY query),
prs AS (SELECT h.query, h.ord, h.score::DOUBLE AS score, self, q, coalesce(list_filter(list_slice(brks, 1, len(list_intersect(h.ids, bids))), lambda r: r <> 0)[-1], 0) AS rank
    FROM {src} h JOIN best USING (query) WHERE h.ord <> bord),
oth AS (SELECT *, """ + SIMPLE + """ AS r FROM prs)"""

SLOTS = """
, agg AS (SELECT query{k}, """ + ", ".join(f"max(score) FILTER (r = {k}) AS b{k}, min(score) FILTER (r = {k}) AS w{k}" for k in range(1, 8)) + """ FROM oth GROUP BY query{k}),
s0 AS (SELECT b.*, """ + ", ".join(f"coalesce(b{k}, 0)::DOUBLE AS x{k}, coalesce(w{k}, 0)::DOUBLE AS v{k}" for k in range(1, 8)) + """, self::DOUBLE AS x0, self::DOUBLE AS v0 FROM best b LEFT JOIN agg USING (query{k})),
s1 AS (SELECT * REPLACE (""" + ", ".join(f"CASE WHEN x{k} < greatest({', '.join(f'x{j}' for j in range(k + 1, 8))}, 0) THEN 0 ELSE x{k} END AS x{k}" for k in range(1, 7)) + """) FROM s0),
s2 AS (SELECT *, """ + ", ".join(
    f"CASE WHEN x{k} = 0 AND ({' OR '.join(f'x{j} <> 0' for j in range(k + 1, 8))}) THEN (SELECT l.x + (r.x - l.x) * ({k} - l.k) / (r.k - l.k)::DOUBLE FROM "
    f"(SELECT CASE {' '.join(f'WHEN x{j} <> 0 THEN x{j}' for j in range(k - 1, 0, -1))} ELSE x0 END AS x, CASE {' '.join(f'WHEN x{j} <> 0 THEN {j}' for j in range(k - 1, 0, -1))} ELSE 0 END AS k) l, "
    f"(SELECT CASE {' '.join(f'WHEN x{j} <> 0 THEN x{j}' for j in range(k + 1, 8))} END AS x, CASE {' '.join(f'WHEN x{j} <> 0 THEN {j}' for j in range(k + 1, 8))} END AS k) r) END AS f{k}".replace("CASE  ELSE x0 END", "x0").replace("CASE  ELSE 0 END", "0")
    for k in range(1, 7)
) + """ FROM s1),
s3 AS (SELECT * REPLACE (""" + ", ".join(f"CASE WHEN f{k} IS NOT NULL AND v{k} = 0 THEN f{k} ELSE v{k} END AS v{k}, coalesce(f{k}, x{k}) AS x{k}" for k in range(1, 7)) + """) FROM s2),
s4 AS (SELECT *, CASE """ + " ".join(f"WHEN q <= x{k - 1} THEN {k}" for k in range(7, 0, -1)) + """ ELSE 0 END AS r, [x0, x1, x2, x3, x4, x5, x6, x7] AS xs, [v0, v1, v2, v3, v4, v5, v6, v7] AS vs FROM s3),
s5 AS (SELECT *, r - CASE WHEN r > 0 AND q > xs[r + 1] AND q >= vs[r] THEN 1 ELSE 0 END AS slot FROM s4),
s6 AS (SELECT *, xs[slot + 1] = 0 AND slot < 7 AS no_worse, [27, 23, 19, 14, 8, 5, 1, 0][slot + 1] AS rank_id FROM s5),
res AS (SELECT *, CASE WHEN rank_id > 0 THEN coalesce(bids[list_position(brks, list_max(list_filter(brks, lambda z: z > 0 AND z <= rank_id)))], -1) ELSE -1 END AS cut FROM s6)
"""


def scored(spark, sf):
    """Hits with path and the query's score, taken from the best hit."""
    return with_query_score(hits_with_path(spark, sf))


def with_query_score(rows):
    return rows.withColumn("query_score", F.max("score").over(H.whole()) * (70 + F.col("query") % 31) / F.lit(100.0))


@query("best_worst_per_rank", O.sql("SELECT query, r, max(score) AS best, min(score) AS worst FROM oth WHERE r > 0 GROUP BY query, r", *O.TREE_HITS, PAIRS.format(src="ph")))
def best_worst_per_rank(spark, sf):
    rows = C.reciprocal(scored(spark, sf)).where("ord <> best_ord").withColumn("r", ranks.simple_rank(F.col("rank")))
    return rows.where("r > 0").groupBy("query", "r").agg(F.max(F.col("score").cast("double")).alias("best"), F.min(F.col("score").cast("double")).alias("worst"))


@query("reciprocal_scores", O.sql("SELECT query, ord, score, rank FROM oth", *O.TREE_HITS, PAIRS.format(src="ph")))
def reciprocal_scores(spark, sf):
    rows = C.reciprocal(scored(spark, sf)).where("ord <> best_ord")
    return rows.select("query", F.col("ord").cast("long").alias("ord"), F.col("score").cast("double").alias("score"), "rank")


@query("core_classify", O.sql("SELECT query, slot, rank_id, no_worse FROM res", *O.TREE_HITS, PAIRS.format(src="ph"), SLOTS.replace("{k}", "")))
def core_classify(spark, sf):
    return C.classify(scored(spark, sf)).select("query", "slot", "rank_id", "no_worse")


# Hits up to the first of a poor e-value, without short ones; each with the rank that its alignment supports.
USABLE = f""", alw AS (SELECT query, ord, {ALN} FROM ph), sup AS (SELECT query, ord, coalesce({RANK_FOR}, 0) AS support FROM alw),
use AS (SELECT * FROM (SELECT ph.*, support, max(CASE WHEN ev > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY ph.query ORDER BY ph.ord) AS f FROM ph JOIN sup ON ph.query = sup.query AND ph.ord = sup.ord) WHERE f = 0 AND aln_len >= 10)"""
COMPUTED = """, bs AS (SELECT query, max_by(support, (score, -ord)) AS support FROM use GROUP BY query),
red AS (SELECT res.*, coalesce(bids[list_position(brks, list_max(list_filter(brks, lambda z: z > 0 AND z <= support)))], 0) AS alone,
  coalesce(bids[list_position(brks, list_max(list_filter(brks, lambda z: z > 0 AND z <= least(support, rank_id))))], 0) AS again FROM res JOIN bs USING (query))
SELECT o.o_orderkey AS query, CASE WHEN n IS NULL THEN 'not_possible' WHEN n = 1 THEN 'single_hit' WHEN cut < 0 THEN 'no_valid_rank' ELSE 'interval_BLASTX' END AS property,
 CASE WHEN n IS NULL THEN 0 WHEN n = 1 THEN alone WHEN cut < 0 THEN 0 WHEN no_worse THEN again ELSE cut END AS taxid FROM orders o LEFT JOIN red ON o.o_orderkey = query"""


@query("compute_classification", O.sql(COMPUTED, *O.TREE_HITS, USABLE, PAIRS.format(src="use"), SLOTS.replace("{k}", "")))
def compute_classification(spark, sf):
    queries = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"))
    rows = C.with_support(aligned(spark, sf)).withColumns({"tail": F.col("ev") > 8, "masked": F.col("aln_len") < 10})
    usable = H.take_while(rows, F.col("tail")).where("not masked")
    return C.computed(queries, with_query_score(usable))


@query("adaptive_top_percent", O.sql("""SELECT query, share, taxid, property FROM (SELECT query.q AS query, query.p AS share, CASE WHEN cut < 0 THEN 0 ELSE cut END AS taxid, CASE WHEN cut < 0 THEN 'no_valid_rank' ELSE 'interval_BLASTX' END AS property,
  row_number() OVER (PARTITION BY query.q ORDER BY query.p) AS rn FROM res JOIN exh USING (query) WHERE NOT no_worse OR exhausted OR query.p = 1.0) WHERE rn = 1""", *O.TREE_HITS, """
, wide AS (SELECT ph.*, p::DOUBLE AS p, max(score) OVER (PARTITION BY ph.query, p) AS mx FROM ph, (VALUES (0.1), (0.3), (0.6), (1.0)) v(p)),
flg AS (SELECT *, CASE WHEN score < (1 - p) * mx THEN 1 ELSE 0 END AS f FROM wide),
tl AS (SELECT *, max(f) OVER (PARTITION BY query, p ORDER BY ord) AS tail, max(f) OVER (PARTITION BY query, p) AS anyf FROM flg),
kp AS (SELECT {'q': query, 'p': p} AS query, ord, score, ids, rks, anyf, mx FROM tl WHERE tail = 0),
exh AS (SELECT query, max(anyf) = 0 AS exhausted FROM kp GROUP BY query)""", PAIRS.format(src="kp").replace("max(score) * (70 + query % 31)", "max(mx) * (70 + query.q % 31)"), SLOTS.replace("{k}", "")))
def adaptive_top_percent(spark, sf):
    rows = with_query_score(R.with_line(S.hits(spark, sf), tree(spark, sf)))
    return C.adaptive(rows).select("query", "share", "taxid", "property")


@query("lca_classify", O.sql("SELECT query, CASE WHEN lca < 1 THEN 0 ELSE lca END AS taxid, CASE WHEN lca < 1 THEN 'not_possible' ELSE 'lca' END AS property FROM lca", *O.TREE_HITS, LCA_ROOT))
def lca_classify(spark, sf):
    rows = T.lca_by_number(hits_some_without(spark, sf), numbered_tree(spark, sf))
    found = F.col("lca") >= 1
    return rows.select("query", F.when(found, F.col("lca")).otherwise(0).alias("taxid"), F.when(found, "lca").otherwise("not_possible").alias("property"))


@query("best_hit_classify", O.sql("SELECT query, min_by(taxid, ord) AS taxid FROM hits GROUP BY query", O.NODES, O.HITS))
def best_hit_classify(spark, sf):
    return H.first_hit(S.hits(spark, sf), "taxid")


@query("classify_empty", O.sql("SELECT o_orderkey AS query, 0 AS taxid, '-' AS evalue FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"))
def classify_empty(spark, sf):
    queries = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"))
    hit = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"))
    return queries.join(hit, "query", "left_anti").select("query", F.lit(0).alias("taxid"), F.lit("-").alias("evalue"))


@query("best_hmm_domain", O.sql("SELECT query, min_by(part, (ev, score, ord)) AS family FROM hits GROUP BY query", O.NODES, O.HITS))
def best_hmm_domain(spark, sf):
    """Of a read's domains the one of least full e-value, then least domain e-value, then the first."""
    rows = S.hits(spark, sf)
    return rows.groupBy("query").agg(F.min_by("part", F.struct("ev", "score", "ord")).alias("family"))
