"""Hand-sized expectations and properties of the core."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import ranks, sequence
from rankloom.operators import classify, profile, taxonomy
from rankloom.operators.chunks import chunked
from rankloom.sources import parsers

# self score, query score, others (score, rank), rank, no_worse
CASES = [
    (100, 80, [(90, 23), (70, 19), (60, 14), (40, 5)], 19, False),
    (100, 95, [(99, 27)], 23, True),
    (100, 50, [(90, 23), (45, 23)], 23, False),
    (100, 65, [(60, 23), (80, 14)], 8, True),
    (100, 10, [(30, 1), (20, 0)], 0, False),
    (100, 100, [(90, 23)], 27, False),
]


def test_core_cases(spark):
    others = spark.createDataFrame([(k, s, r) for k, c in enumerate(CASES) for s, r in c[2]], "query int, score int, rank int")
    base = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(CASES)], "query int, self_score int, query_score int")
    rows = classify.core(base.join(classify.intervals(others), "query", "left")).collect()
    got = {r["query"]: (r["rank_id"], r["no_worse"]) for r in rows}
    assert got == {k: (c[3], c[4]) for k, c in enumerate(CASES)}


def mirror(s, q, others):
    """The steps in plain Python."""
    least = [27, 23, 19, 14, 8, 5, 1]
    simple = lambda r: next((k for k, x in enumerate(least) if r >= x), 7)
    best, worst = [s] + [0.0] * 7, [s] + [0.0] * 7
    for score, rank in others:
        r = simple(rank)
        if r:
            best[r], worst[r] = max(best[r], score), score if worst[r] == 0 else min(worst[r], score)
    top = 0
    for r in range(7, 0, -1):
        if best[r] < top:
            best[r] = 0
        top = max(top, best[r])
    for r in range(1, 7):
        if best[r] == 0:
            left = next(k for k in range(r - 1, -1, -1) if best[k])
            right = next((k for k in range(r + 1, 8) if best[k]), None)
            if right is None:
                break
            best[r] = best[left] + (best[right] - best[left]) * (r - left) / (right - left)
            worst[r] = worst[r] or best[r]
    r = 7
    while r > 0 and q > best[r - 1]:
        r -= 1
    if r > 0 and q > best[r] and q >= worst[r - 1]:
        r -= 1
    return [27, 23, 19, 14, 8, 5, 1, 0][r], best[r] == 0 and r < 7


def test_core_random(spark):
    rng = random.Random(3)
    cases = []
    for k in range(300):
        s = rng.randint(50, 120)
        cases.append((k, float(s), float(rng.randint(5, s)), [(float(rng.randint(1, s)), rng.choice([0, 1, 5, 8, 14, 19, 23, 27])) for _ in range(rng.randint(0, 6))]))
    others = spark.createDataFrame([(k, s, r) for k, _, _, o in cases for s, r in o], "query int, score double, rank int")
    base = spark.createDataFrame([c[:3] for c in cases], "query int, self_score double, query_score double")
    got = {r["query"]: (r["rank_id"], r["no_worse"]) for r in classify.core(base.join(classify.intervals(others), "query", "left")).collect()}
    assert got == {k: mirror(s, q, o) for k, s, q, o in cases}


NODES = [(1, 1, 0), (131567, 1, 0), (2, 131567, 1), (10, 2, 5), (20, 10, 8), (30, 20, 19), (31, 20, 19), (40, 30, 23), (50, 40, 27), (51, 40, 27), (12908, 1, 0), (77, 12908, 27), (900, 899, 27)]


@pytest.fixture(scope="module")
def tree(spark):
    return taxonomy.lineages(spark.createDataFrame(NODES, "taxid int, parent int, rank int"))


def test_lineages(spark, tree):
    got = {r["taxid"]: [x["taxid"] for x in r["path"]] for r in tree.collect()}
    assert got[50] == [1, 131567, 2, 10, 20, 30, 40, 50]
    assert got[1] == [1] and 900 not in got


def test_lca(spark, tree):
    hits = spark.createDataFrame([(1, 50), (1, 51), (2, 50), (2, 31), (3, 77), (4, 40), (4, 50), (5, 50), (5, 77)], "query int, taxid int")
    got = {r["query"]: r["lca"] for r in taxonomy.lca_of_hits(taxonomy.with_path(hits, tree)).collect()}
    assert got == {1: 40, 2: 20, 3: -1, 4: 40, 5: 50}


def test_rank_functions(spark, tree):
    row = tree.where("taxid = 50").select(
        ranks.reduce_by_rank(F.col("path"), F.lit(14)).alias("cut"), ranks.reduce_by_rank(F.col("path"), F.lit(0)).alias("none"),
        ranks.taxon_at_rank(F.col("path"), F.lit(14)).alias("below"), ranks.taxon_at_rank(F.col("path"), F.lit(19)).alias("same"), ranks.lowest_rank(F.col("path")).alias("low"),
    ).first()
    assert tuple(row) == (20, -1, 30, 30, 27)


def test_sequences(spark):
    row = spark.range(1).select(
        *[sequence.translate_frame(F.lit("ATGGCCTAA"), f).alias(str(f)) for f in (1, 2, 3, -1, -2, -3)],
        sequence.reverse_complement(F.lit("ACGTAC")).alias("rc"), sequence.dna_score(F.lit("AC-GT"), F.lit("ACTGA"), F.lit(0), F.lit(9)).alias("dna"),
        sequence.m8_score(F.lit(90), F.lit(100), F.lit(8), F.lit(1)).alias("m8"), sequence.mask_outer_gaps(F.lit("--A-C-")).alias("mask"), sequence.translate_frame(F.lit("AC"), -1).alias("short"),
    ).first()
    assert tuple(row) == ("MA*", "WP", "GL", "LGH", "RP", "*A", "GTACGT", -1, 63, "??A-C?", "")
    matrix = F.create_map(F.lit("AA"), F.lit(4))
    long, short = (spark.range(1).select(sequence.matrix_score(F.lit("A" * n), F.lit("A" * n), F.lit(0), F.lit(99), matrix).alias("s")).first()["s"] for n in (25, 24))
    assert (long, short) == (100, 0)


def test_comparative_profile(spark):
    rows = spark.createDataFrame([("A", "g", "x", 90), ("A", "g", "y", 9), ("A", "g", "z", 1), ("B", "g", "x", 99), ("B", "g", "y", 1)], "sample string, rank string, taxon string, n int")
    got = {(r["sample"], r["taxon"]): round(r["share"], 4) for r in profile.comparative_profile(rows, 0.05).collect()}
    assert got == {("A", "x"): 0.9091, ("A", "y"): 0.0909, ("B", "x"): 0.99, ("B", "y"): 0.01}
    other = {r["sample"]: round(r["other"], 4) for r in profile.comparative_other(rows, 0.05).collect()}
    assert other == {"A": 0.01, "B": 0.0}


def test_merging_and_chunks(spark):
    rows = spark.createDataFrame([("r", "1e-5", 7), ("r", "-", 8), ("q", "-", 9)], "read string, evalue string, taxid int")
    assert [tuple(r) for r in profile.best_evalue_wins(rows).collect()] == [("r", 7, "1e-5")]
    sizes = [r["count"] for r in chunked(spark.range(10), "id", 4).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [3, 3, 2, 2]


def test_report(spark):
    text = "BLASTX 2.2\nQuery= r1\n\n>gi|5 some\n protein [X y]\n          Length = 9\n\n Score = 50.1 bits (9), Expect = e-20\n Identities = 3/4 (75%), Positives = 4/4 (100%)\n Frame = -2\n\nQuery: 10 AC 11\nSbjct: 1 AC 2\n\nQuery: 12 GT 13\nSbjct: 3 GA 4\n"
    row = parsers.blast_report(spark.createDataFrame([(text,)], "value string")).first()
    assert (row["query"], row["subject"], row["bitscore"], row["evalue"], row["identities"], row["gaps"], row["frame"]) == ("r1", "gi|5 some protein [X y]", 50.1, 1e-20, 3, 0, -2)
    assert (row["q_start"], row["q_end"], row["q_seq"], row["s_seq"]) == (10, 13, "ACGT", "ACGA")
