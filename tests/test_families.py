"""Scores in blocks of families against the column expression and plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions import sequence
from rankloom.operators import families

MATRIX = {a + b: (5 if a == b else -4 + (ord(a) * ord(b)) % 6) for a in "*" + sequence.AMINO for b in "*" + sequence.AMINO}
MATRIX = {k: MATRIX["".join(sorted(k))] for k in MATRIX}


def plain(a, b, first=0, last=1 << 30):
    cols = list(zip(a, b))[first : last + 1]
    if len(cols) < families.LEAST_COLUMNS:
        return 0
    total = 0
    for x, y in cols:
        known = [c in sequence.AMINO for c in (x, y)]
        if "?" not in (x, y) and any(known):
            total += MATRIX[(x if known[0] else "*") + (y if known[1] else "*")]
    return total


def strings(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice(sequence.AMINO + "-?xé") for _ in range(draw.choice([0, 5, 24, 25, 60, 64, 65, 130]))) for _ in range(n)]


def test_scores_equal_the_column_expression(spark):
    rows, members = strings(1, 12), strings(2, 15)
    got = families.scores(pd.Series(rows), pd.Series(members), families._table(MATRIX))
    assert got.tolist() == [[plain(a, b) for b in members] for a in rows]
    df = spark.createDataFrame([(a, b, plain(a, b)) for a in rows for b in members], "a string, b string, want int")
    assert df.where(sequence.matrix_score(F.col("a"), F.col("b"), F.lit(0), F.lit(1 << 30), MATRIX) != F.col("want")).count() == 0


def families_of(spark):
    """One family holds most rows; others are small, empty on a side, null, or hold rows alike."""
    rows = [(k, "hot" if k % 4 else f"f{k % 3}", r) for k, r in enumerate(strings(3, 40))] + [(90, "lone", "A" * 30), (91, None, "A" * 30), (92, "hot", None), (3, "hot", "C" * 30), (3, "hot", "C" * 30)]
    members = [(f"m{k:02}", "hot" if k % 3 else f"f{k % 4}", r) for k, r in enumerate(strings(4, 40))]
    members += [(f"n{k}", "hot", members[1][2]) for k in range(9)] + [members[1]] * 5 + [("x", None, "A" * 30), ("y", "hot", None), ("z", "bare", "A" * 30)]
    m = [(f, n, int(n[1:] or 0) % 5 if n[1:] else None, r) for n, f, r in members]
    return rows, m, spark.createDataFrame(rows, "query int, family string, row string"), spark.createDataFrame(m, "family string, member string, taxid int, m_row string")


@pytest.mark.parametrize("block", [4, 256])
def test_best_members(spark, block):
    rows, members, df, m = families_of(spark)
    extra = df.withColumn("member", F.lit("clash")).withColumn("_r", F.lit(1)).withColumn("score", F.lit(0))
    got = sorted((r["query"], r["row"], r["score"], r["member"], r["taxid"]) for r in families.best_members(extra, m, MATRIX, block).collect())
    want = []
    for q, f, row in set(rows):
        own = [(-plain(row, r), n, r, t) for g, n, t, r in members if f is not None and row is not None and g == f and r is not None]
        if own:
            score, member, _, taxid = min(own)
            want.append((q, row, -score, member, taxid))
    assert got == sorted(want) and len(got) > 35


def test_best_members_but_itself(spark):
    df = spark.createDataFrame([(1, "f", "A" * 30), (2, "f", "A" * 29 + "C"), (3, "f", "W" * 30), (4, "g", "A" * 30)], "query int, family string, row string")
    m = df.select("family", F.col("query").alias("member"), F.lit(0).alias("taxid"), F.col("row").alias("m_row"))
    got = {r["query"]: r["member"] for r in families.best_members(df, m, MATRIX, 2, others=True).collect()}
    want = {q: min((-plain(a, b), k) for k, b in ((1, "A" * 30), (2, "A" * 29 + "C"), (3, "W" * 30)) if k != q)[1] for q, a in ((1, "A" * 30), (2, "A" * 29 + "C"), (3, "W" * 30))}
    assert got == want


@pytest.mark.parametrize("block", [5, 256])
def test_score_ranges(spark, block):
    rows, members, df, m = families_of(spark)
    asked = df.withColumns({"own": F.col("query") % 7, "first": F.col("query") % 3, "last": 30 + F.col("query")})
    got = {(r["query"], r["own"], r["taxid"]): (r["best"], r["worst"]) for r in families.score_ranges(asked, m, MATRIX, -60, block).collect()}
    want = {}
    for q, f, row in rows:
        for g, _, t, r in members:
            if f is not None and g == f and row is not None and r is not None and (s := plain(row, r, q % 3, 30 + q)) >= -60:
                best, worst = want.get((q, q % 7, t), (s, s))
                want[q, q % 7, t] = (max(best, s), min(worst, s))
    assert got == want and len(got) > 100


def test_empty_tables(spark):
    _, _, df, m = families_of(spark)
    assert families.best_members(df.limit(0), m, MATRIX).count() == families.best_members(df, m.limit(0), MATRIX).count() == 0
