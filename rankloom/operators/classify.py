"""Assigning a taxon to each query by comparing its score with the score intervals of all ranks.

Input of the core is one row a query: self_score, query_score and, for each simple rank 1 to 7, the best and
the worst score of the other sequences whose common ancestor with the best hit has that rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.operators import hits as H

#: What the property of a classified query begins with; the match type follows.
PREFIX = "interval"


def held(rows: DataFrame) -> DataFrame:
    """The same rows, worked out here: else the optimiser would put long expressions into every place that names them."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


def intervals(others: DataFrame) -> DataFrame:
    """query, b1..b7, w1..w7: best and worst score per simple rank of others (query, score, rank); null where there is none."""
    r = ranks.simple_rank(F.col("rank"))
    aggs = []
    for k in range(1, 8):
        own = F.when(F.col("_r") == k, F.col("score").cast("double"))
        aggs += [F.max(own).alias(f"b{k}"), F.min(own).alias(f"w{k}")]
    return others.withColumn("_r", r).groupBy("query").agg(*aggs)


def slots(own: np.ndarray, asked: np.ndarray, best: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """slot, and the best score there, of each of n self and query scores with n x 7 best and worst scores by simple rank 1 to 7; 0 is unset."""
    n = len(own)
    best, worst = np.column_stack([own, best]), np.column_stack([own, worst])
    # Scores may not fall towards the species: from 7 down, what lies under the running maximum is unset.
    above = np.maximum(best[:, 7], 0.0)
    for k in range(6, 0, -1):
        given = best[:, k].copy()
        best[given < above, k] = 0.0
        above = np.maximum(above, given)
    # Unset slots between two set ones are interpolated; worst scores follow where they are unset.
    left, left_at = np.empty((n, 8)), np.zeros((n, 8))
    left[:, 1] = best[:, 0]
    for k in range(2, 8):
        is_set = best[:, k - 1] != 0
        left[:, k], left_at[:, k] = np.where(is_set, best[:, k - 1], left[:, k - 1]), np.where(is_set, k - 1, left_at[:, k - 1])
    right, right_at, filled = np.full(n, np.nan), np.full(n, np.nan), {}
    for k in range(6, 0, -1):
        is_set = best[:, k + 1] != 0
        right, right_at = np.where(is_set, best[:, k + 1], right), np.where(is_set, k + 1, right_at)
        filled[k] = left[:, k] + (right - left[:, k]) * (k - left_at[:, k]) / (right_at - left_at[:, k])
    for k, value in filled.items():
        use = (best[:, k] == 0) & ~np.isnan(value)
        worst[:, k] = np.where(use & (worst[:, k] == 0), value, worst[:, k])
        best[:, k] = np.where(use, value, best[:, k])
    # Down from 7 as long as the query beats the next slot's best score.
    down = np.zeros(n, np.int64)
    for k in range(1, 8):
        down = np.where(asked <= best[:, k - 1], k, down)
    row = np.arange(n)
    slot = down - ((down > 0) & (asked > best[row, down]) & (asked >= worst[row, np.maximum(down - 1, 0)]))
    return slot, best[row, slot]


def core(rows: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Adds slot (simple rank), no_worse and rank_id to rows (self_score, query_score, b1..b7, w1..w7).

    Every step is taken for all rows of a batch at once over eight slots; a value of 0 means that a slot is unset.
    """

    @F.pandas_udf("struct<slot: int, no_worse: boolean>")
    def placed(own: pd.Series, asked: pd.Series, *scores: pd.Series) -> pd.DataFrame:
        each = np.column_stack([x.to_numpy(np.float64) for x in scores])
        slot, best = slots(own.to_numpy(np.float64), asked.to_numpy(np.float64), each[:, :7], each[:, 7:])
        none = pd.Series((best == 0) & (slot < 7), dtype="boolean").mask(np.isnan(best))
        return pd.DataFrame({"slot": slot.astype(np.int32), "no_worse": none})

    s, q = F.col("self_score").cast("double"), F.col("query_score").cast("double")
    q = F.least(q * multiplier, s) if multiplier != 1.0 else q
    found = placed(s, q, *[F.coalesce(F.col(f"{x}{k}").cast("double"), F.lit(0.0)) for x in "bw" for k in range(1, 8)])
    out = rows.withColumn("_found", found).select(*rows.columns, F.col("_found.slot").alias("slot"), F.col("_found.no_worse").alias("no_worse"))
    out = out.withColumn("rank_id", F.get(F.array(*[F.lit(r) for r in ranks.RANK_OF_SIMPLE]), F.col("slot")))
    return held(out.drop(*[c for c in out.columns if c.startswith("_")]))


def assign(rows: DataFrame, match_type: str = "BLASTX") -> DataFrame:
    """Adds taxid and property: the best hit's lineage (path) cut at the rank; a null self or query score is not possible.

    With a column `support`, the rank that the best hit's alignment supports (0: none), a result without a worse
    hit is cut anew at that rank, and gets taxid 0 where nothing is left.
    """
    cut = F.when(F.col("rank_id") > 0, ranks.reduce_by_rank(F.col("path"), F.col("rank_id"))).otherwise(-1)
    if "support" in rows.columns:
        rows, cut = held(rows.withColumn("_by_score", cut)), F.col("_by_score")
        again = F.greatest(ranks.reduce_by_rank(F.col("path"), F.least("rank_id", "support")), F.lit(0))
        cut = F.when((cut > 0) & F.col("no_worse"), again).otherwise(cut)
    possible = F.col("self_score").isNotNull() & F.col("query_score").isNotNull()
    out = held(rows.withColumn("_cut", F.when(possible, cut)))
    prop = F.when(~possible, "not_possible").when(F.col("_cut") < 0, "no_valid_rank").otherwise(f"{PREFIX}_{match_type}")
    return out.withColumn("property", prop).withColumn("taxid", F.when(F.col("_cut") >= 0, F.col("_cut")).otherwise(0)).drop("_cut", "_by_score")


def reciprocal(rows: DataFrame) -> DataFrame:
    """query, self_score, query_score, best path and others (score, rank) from hits with path: the best hit plays the self.

    query_score is given by the column `query_score` of the best hit, `support` too if there is one; other hits
    take the rank of their common ancestor with it. The best hit is broadcast over its query's rows by a window,
    not joined.
    """
    more = [c for c in ("support",) if c in rows.columns]
    best = F.min(F.struct(F.lit(0) - F.col("score"), "ord", "taxid", "path", "query_score", *more)).over(H.whole())
    out = rows.withColumn("_best", best)
    shared = F.filter("path", lambda s: F.array_contains(ranks.taxids(F.col("_best.path")), s["taxid"]))
    return out.select(
        "query", "ord", "score", F.col("_best.ord").alias("best_ord"), F.col("_best.taxid").alias("best_taxid"), F.col("_best.path").alias("best_path"),
        F.col("_best.query_score").alias("query_score"), ranks.lowest_rank(shared).alias("rank"),
        *[F.col(f"_best.{c}").alias(c) for c in more],
    )


def classify(rows: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """query, taxid, property, slot, no_worse of hits with path and query_score: one aggregate over each query's hits."""
    pairs = reciprocal(rows)
    r = ranks.simple_rank(F.col("rank"))
    pairs = pairs.withColumn("_r", F.when(F.col("ord") != F.col("best_ord"), r))
    aggs = [F.max(F.when(F.col("ord") == F.col("best_ord"), F.col("score"))).alias("self_score"), F.first("query_score").alias("query_score"), F.first("best_path").alias("path"), F.count(F.lit(1)).alias("n_hits")]
    aggs += [F.first(c).alias(c) for c in ("support",) if c in pairs.columns]
    for k in range(1, 8):
        own = F.when(F.col("_r") == k, F.col("score").cast("double"))
        aggs += [F.max(own).alias(f"b{k}"), F.min(own).alias(f"w{k}")]
    return assign(core(pairs.groupBy("query").agg(*aggs), multiplier))


def with_support(rows: DataFrame) -> DataFrame:
    """Adds support: the rank that a hit's alignment (q_len, identity, gaps, positives, identities) supports, 0 if none."""
    rank = ranks.least_rank_for(F.col("q_len"), F.col("identity"), F.col("gaps"), F.col("positives") - F.col("identities"))
    return rows.withColumn("support", F.coalesce(rank, F.lit(0)))


def adaptive(rows: DataFrame, shares: tuple[float, ...] = (0.1, 0.3, 0.6, 1.0), stop_exhausted: bool = True) -> DataFrame:
    """query, share, taxid, property, no_worse: the first share of the best score whose result has a worse hit, or whose hits are exhausted; else the last.

    rows: hits with line, their packed lineage, and query_score; see classify. Each hit is there once: its level is the first share
    that keeps it, and each share has its own best hit. Tabular input does not look whether hits are exhausted (stop_exhausted false).
    """
    steps, more = range(len(shares)), [c for c in ("support",) if c in rows.columns]
    rows = rows.withColumns({"_low": F.min("score").over(H.so_far()), "_top": F.max("score").over(H.whole()), "_least": F.min("score").over(H.whole())})
    keeps = lambda value, k: value >= (1 - shares[k]) * F.col("_top")
    rows = rows.withColumns({**{f"_kept_{k}": keeps(F.col("_low"), k) for k in steps}, **{f"_all_{k}": keeps(F.col("_least"), k) for k in steps}})
    best = F.struct(F.lit(0) - F.col("score"), "ord", "taxid", "line", "query_score", *more)
    rows = rows.withColumns({f"_best_{k}": F.min(F.when(F.col(f"_kept_{k}"), best)).over(H.whole()) for k in steps})
    own = lambda k: F.col("ord") == F.col(f"_best_{k}.ord")
    rows = rows.withColumns({f"_r_{k}": F.when(F.col(f"_kept_{k}") & ~own(k), ranks.shared_simple_rank(F.col(f"_best_{k}.line"), F.col("line"))) for k in steps})
    aggs = []
    for k in steps:
        aggs += [F.count_if(f"_kept_{k}").alias(f"n_{k}"), F.first(f"_best_{k}").alias(f"best_{k}"), F.max(F.when(F.col(f"_kept_{k}") & own(k), F.col("score"))).alias(f"self_{k}"), F.bool_and(f"_all_{k}").alias(f"all_{k}")]
        for r in range(1, 8):
            one = F.when(F.col(f"_r_{k}") == r, F.col("score").cast("double"))
            aggs += [F.max(one).alias(f"b{r}_{k}"), F.min(one).alias(f"w{r}_{k}")]
    wide = rows.groupBy("query").agg(*aggs)
    step = lambda k: F.struct(F.lit(shares[k]).alias("share"), F.col(f"n_{k}").alias("n"), F.col(f"best_{k}").alias("best"), F.col(f"self_{k}").alias("self_score"), F.col(f"best_{k}.query_score").alias("query_score"), F.col(f"all_{k}").alias("exhausted"), *[F.col(f"best_{k}.{c}").alias(c) for c in more], *[F.col(f"{x}{r}_{k}").alias(f"{x}{r}") for x in "bw" for r in range(1, 8)])
    each = wide.select("query", F.explode(F.array(*[step(k) for k in steps])).alias("s")).select("query", "s.*").where("n > 0")
    results = assign(core(each.withColumn("path", ranks.unpacked(F.col("best.line"))).drop("best")))
    final = ~F.col("no_worse") | (F.col("exhausted") & F.lit(stop_exhausted)) | (F.col("share") == shares[-1])
    first = F.min(F.struct("share", "taxid", "property", "no_worse"))
    return results.where(final).groupBy("query").agg(first.alias("r")).select("query", "r.*")


def computed(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query, property, taxid of every query: without usable hits not possible, with one its own taxon, else by intervals.

    Usable are hits before the first with `tail` and without `masked`, where there are such columns. With `support`
    the single hit's taxon is cut at that rank.
    """
    if "tail" in rows.columns:
        rows = H.take_while(rows, F.col("tail"))
    if "masked" in rows.columns:
        rows = rows.where(~F.col("masked"))
    results = classify(rows)
    single = F.col("n_hits") == 1
    own = F.get("path", F.size("path") - 1)["taxid"]
    if "support" in rows.columns:
        own = F.greatest(ranks.reduce_by_rank(F.col("path"), F.col("support")), F.lit(0))
    found = results.select("query", F.when(single, "single_hit").otherwise(F.col("property")).alias("property"), F.when(single, own).otherwise(F.col("taxid")).alias("taxid"))
    out = queries.join(found, "query", "left")
    return out.select("query", F.coalesce("property", F.lit("not_possible")).alias("property"), F.coalesce("taxid", F.lit(0)).alias("taxid"))
