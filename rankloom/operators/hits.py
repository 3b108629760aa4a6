"""Filters over the hits of a query. Hits have query, ord (their order), taxid, score, aln_len, ev.

Filters that end a scan (e-value, bit score, top percent) keep the hits before the first that fails;
they are running maxima over one window by query, so several cost one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rankloom.functions import ranks

def by_order() -> WindowSpec:
    return Window.partitionBy("query").orderBy("ord")


def so_far() -> WindowSpec:
    return by_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole() -> WindowSpec:
    return Window.partitionBy("query")


def take_while(rows: DataFrame, fails: Column) -> DataFrame:
    """Hits of each query before the first that fails."""
    return rows.withColumn("_fail", F.max(F.coalesce(fails, F.lit(False)).cast("int")).over(so_far())).where("_fail = 0").drop("_fail")


def filter_evalue(rows: DataFrame, most) -> DataFrame:
    return take_while(rows, F.col("ev") > most)


def filter_bitscore(rows: DataFrame, least) -> DataFrame:
    return take_while(rows, F.col("score") < least)


def filter_alignment_length(rows: DataFrame, least: int) -> DataFrame:
    return rows.where(F.col("aln_len") >= least)


def best_first(rows: DataFrame) -> DataFrame:
    """Moves hits that beat the best so far to the front, the best one first, as a report is read."""
    before = F.max("score").over(by_order().rowsBetween(Window.unboundedPreceding, -1))
    front = F.col("score") > F.coalesce(before, F.lit(float("-inf")))
    place = F.when(F.col("_front"), -F.col("ord")).otherwise(F.col("ord"))
    return rows.withColumn("_front", front).withColumn("ord", place).drop("_front")


def top_percent(rows: DataFrame, share: float | Column) -> DataFrame:
    """Adds fails (the hit ends the scan) and exhausted (no hit of the query fails) for the best score less the share."""
    limit = (1 - (share if isinstance(share, Column) else F.lit(share))) * F.max("score").over(whole())
    out = rows.withColumn("fails", (F.col("score") < limit).cast("int"))
    return out.withColumn("exhausted", F.max("fails").over(whole()) == 0)


def filter_top_percent(rows: DataFrame, share: float) -> DataFrame:
    out = top_percent(rows, share)
    return out.withColumn("_tail", F.max("fails").over(so_far())).where("_tail = 0").drop("_tail", "fails")


def filter_superkingdom(rows: DataFrame) -> DataFrame:
    """Hits (with path) whose third lineage node is a kept group."""
    ids = ranks.taxids(F.col("path"))
    return rows.where((F.get(ids, F.lit(0)) == 1) & F.get(ids, F.lit(2)).isin(*ranks.KEPT_GROUPS))


def filter_reduced_taxa(rows: DataFrame) -> DataFrame:
    """Adds reduced: the hit's taxon cut to what its alignment (q_len, identity, gaps, positives, identities) supports; -1 if nothing."""
    rank = ranks.least_rank_for(F.col("q_len"), F.col("identity"), F.col("gaps"), F.col("positives") - F.col("identities"))
    return rows.withColumn("reduced", F.when(rank.isNull(), -1).otherwise(ranks.reduce_by_rank(F.col("path"), rank)))


def limits_for(match_type: str, blastx: tuple, blastp: tuple, blastn: tuple) -> tuple:
    """(e-value, bit score, alignment length) of a match type, as the reference applies them: BLASTN takes those meant for BLASTP, all types but BLASTX and BLASTN take none."""
    return {"BLASTX": blastx, "BLASTN": blastp}.get(match_type, (float("inf"), 0, 0))


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Adds place: a hit's place in its query by falling identity or bit score, or by rising e-value; ties by order."""
    key = {"identity": F.desc("identity"), "bitscore": F.desc("score"), "evalue": F.asc("ev")}[by]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(key, "ord")))


def matching_queries(queries: DataFrame, rows: DataFrame, most_ev, least_score, least_length: int, share: float) -> DataFrame:
    """query, n_hits, n_left, evalue, state: `no_hits`, `no_hits2` (all were filtered) or `hits`, after all filters in one window; evalue is the first hit's that is left, `-` if none is.

    The order is e-value, bit score, alignment length, top percent, group; a scan that has ended stays ended.
    """
    best = F.max("score").over(whole())
    fails = (F.col("ev") > most_ev) | (F.col("score") < least_score) | (F.col("score") < (1 - share) * best)
    ids = ranks.taxids(F.col("path"))
    group = (F.get(ids, F.lit(0)) == 1) & F.get(ids, F.lit(2)).isin(*ranks.KEPT_GROUPS)
    kept = rows.withColumn("_tail", F.max(fails.cast("int")).over(so_far())).withColumn("kept", (F.col("_tail") == 0) & (F.col("aln_len") >= least_length) & F.coalesce(group, F.lit(False)))
    counts = kept.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"), F.sum(F.col("kept").cast("long")).alias("n_left"), F.min(F.when(F.col("kept"), F.struct("ord", "ev"))).alias("_first"))
    out = queries.join(counts, "query", "left").withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "n_left": F.coalesce("n_left", F.lit(0))})
    out = out.withColumn("evalue", F.coalesce(F.col("_first.ev").cast("string"), F.lit("-"))).drop("_first")
    return out.withColumn("state", F.when(F.col("n_hits") == 0, "no_hits").when(F.col("n_left") == 0, "no_hits2").otherwise("hits"))


def first_hit(rows: DataFrame, *columns: str) -> DataFrame:
    """The first hit of each query, by an aggregate that combines before the shuffle."""
    best = F.min(F.struct("ord", *columns)).alias("best")
    return rows.groupBy("query").agg(best).select("query", *[F.col(f"best.{c}").alias(c) for c in columns])


def collapse_consecutive(rows: DataFrame, subject: str) -> DataFrame:
    """Hits without those whose subject is that of the hit before."""
    before = F.lag(subject).over(by_order())
    return rows.withColumn("_before", before).where(~F.col(subject).eqNullSafe(F.col("_before"))).drop("_before")


def sorted_hsps(rows: DataFrame) -> DataFrame:
    """Adds rank_in_hit: place by falling score, ties by order."""
    return rows.withColumn("rank_in_hit", F.row_number().over(Window.partitionBy("query", "taxid").orderBy(F.desc("score"), "ord")))
