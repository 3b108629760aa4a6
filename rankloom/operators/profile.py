"""Profiles: reads counted by rank and taxon, compared between samples, and by GO term; merging of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import ranks

#: The ranks of a profile unless others are asked for.
DEFAULT_RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")


def read_ranks(reads: DataFrame, names: DataFrame, wanted: tuple[str, ...] = DEFAULT_RANKS, *keep: str) -> DataFrame:
    """A row (keep, rank, taxon) for each wanted rank of each read (taxid, path).

    Reads without a taxon count as Unknown, those outside cellular organisms as Non-cellular, at superkingdom.
    """
    ids = [ranks.RANKS.index(r) for r in wanted]
    node = lambda rank, taxon: F.struct(F.lit(rank).alias("rank"), F.lit(None).cast("int").alias("node"), F.lit(taxon).alias("label"))
    cellular = F.array_contains(ranks.taxids(F.col("path")), ranks.CELLULAR)
    own = F.transform(F.filter("path", lambda s: s["rank"].isin(*ids)), lambda s: F.struct(ranks.rank_name(s["rank"]).alias("rank"), s["taxid"].alias("node"), F.lit(None).cast("string").alias("label")))
    entries = F.when((F.col("taxid") <= 0) | F.col("path").isNull(), F.array(node("superkingdom", "Unknown"))).when(~cellular, F.array(node("superkingdom", "Non-cellular"))).otherwise(own)
    rows = reads.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.rank", "e.node", "e.label")
    named = names.select(F.col("taxid").alias("_t"), F.col("name").alias("_name"))
    return rows.join(named, F.col("node") == F.col("_t"), "left").select(*keep, "rank", F.coalesce("label", "_name", F.col("node").cast("string")).alias("taxon"))


def taxonomic_profile(reads: DataFrame, names: DataFrame, wanted: tuple[str, ...] = DEFAULT_RANKS) -> DataFrame:
    """rank, taxon, n. Counts are taken by node before names are joined, so only distinct taxa are joined."""
    ids = [ranks.RANKS.index(r) for r in wanted]
    kind = F.when((F.col("taxid") <= 0) | F.col("path").isNull(), "Unknown").when(~F.array_contains(ranks.taxids(F.col("path")), ranks.CELLULAR), "Non-cellular")
    own = F.transform(F.filter("path", lambda s: s["rank"].isin(*ids)), lambda s: F.struct(s["rank"].alias("rank"), s["taxid"].alias("node"), F.lit(None).cast("string").alias("label")))
    other = F.array(F.struct(F.lit(1).alias("rank"), F.lit(None).cast("int").alias("node"), F.col("_kind").alias("label")))
    rows = reads.withColumn("_kind", kind).select(F.explode(F.when(F.col("_kind").isNull(), own).otherwise(other)).alias("e"))
    counts = rows.groupBy("e.rank", "e.node", "e.label").agg(F.count(F.lit(1)).alias("n"))
    named = names.select(F.col("taxid").alias("_t"), F.col("name").alias("_name"))
    out = counts.join(named, F.col("node") == F.col("_t"), "left")
    taxon = F.coalesce("label", "_name", F.col("node").cast("string"))
    return out.select(ranks.rank_name(F.col("rank")).alias("rank"), taxon.alias("taxon"), "n").groupBy("rank", "taxon").agg(F.sum("n").alias("n"))


def unknown_above(reads: DataFrame, cutoff: float, evalue: str = "evalue") -> DataFrame:
    """reads (taxid, path) with those whose e-value is above the cutoff made unknown; an e-value that is no number counts as 0."""
    above = F.coalesce(F.expr(f"try_cast({evalue} as double)"), F.lit(0.0)) > cutoff
    return reads.withColumns({"taxid": F.when(above, 0).otherwise(F.col("taxid")), "path": F.when(~above, F.col("path"))})


def within(rows: DataFrame, cutoff: float, evalue: str = "evalue") -> DataFrame:
    """rows whose e-value is at most the cutoff; one that is no number counts as 0."""
    return rows.where(F.coalesce(F.expr(f"try_cast({evalue} as double)"), F.lit(0.0)) <= cutoff)


def comparative_profile(rows: DataFrame, cutoff: float) -> DataFrame:
    """sample, rank, taxon, n, share of rows (sample, rank, taxon, n): taxa above the cutoff in any sample, shares taken anew."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("sample", "rank"))
    kept = rows.withColumn("_share", share).withColumn("_most", F.max("_share").over(Window.partitionBy("rank", "taxon"))).where(F.col("_most") > cutoff)
    again = F.col("n") / F.sum("n").over(Window.partitionBy("sample", "rank"))
    return kept.select("sample", "rank", "taxon", "n", again.alias("share"))


def comparative_other(rows: DataFrame, cutoff: float) -> DataFrame:
    """sample, rank, total, kept_total, other: what the cutoff takes away of each sample."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("sample", "rank"))
    marked = rows.withColumn("_share", share).withColumn("_kept", F.max("_share").over(Window.partitionBy("rank", "taxon")) > cutoff)
    out = marked.groupBy("sample", "rank").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("_kept"), F.col("n")).otherwise(0)).alias("kept_total"))
    return out.withColumn("other", 1 - F.try_divide("kept_total", "total"))


def comparative_wide(rows: DataFrame, samples: list[str], cutoff: float = 0.0, absolute: bool = False) -> DataFrame:
    """rank, taxon and a column for each of the samples, in their order: the taxon's share of the rank (or its count), 0 where it is absent.

    The samples are given, so the columns need no look at the data; taxa above the cutoff in any sample stay.
    """
    kept = comparative_profile(rows.where(F.col("sample").isin(*samples)), cutoff)
    value = "n" if absolute else "share"
    return kept.groupBy("rank", "taxon").pivot("sample", samples).agg(F.first(value)).fillna(0, subset=samples)


def filtered_away(rows: DataFrame, samples: list[str], cutoff: float) -> DataFrame:
    """rank and for each sample `s` the reads that the cutoff takes away (`s`) and their share of those that stay (`s_share`, null where none stay)."""
    other = comparative_other(rows.where(F.col("sample").isin(*samples)), cutoff)
    away = F.col("total") - F.col("kept_total")
    wide = other.groupBy("rank").pivot("sample", samples).agg(F.first(away).alias("n"), F.first(F.try_divide(away, F.col("kept_total"))).alias("share"))
    return wide.select("rank", *[F.coalesce(F.col(f"`{s}_n`"), F.lit(0)).alias(s) for s in samples], *[F.col(f"`{s}_share`").alias(f"{s}_share") for s in samples])


def functional_profile(rows: DataFrame, terms: DataFrame, alternatives: DataFrame | None = None) -> DataFrame:
    """go_id, term, category, n of rows (go array): counts above 0; alternative ids count for their main one."""
    each = rows.select(F.explode("go").alias("go_id"))
    counts = each.groupBy("go_id").agg(F.count(F.lit(1)).alias("n"))
    if alternatives is not None:
        counts = counts.join(alternatives.select(F.col("alt_id").alias("go_id"), "main_id"), "go_id", "left")
        counts = counts.groupBy(F.coalesce("main_id", "go_id").alias("go_id")).agg(F.sum("n").alias("n"))
    known = terms.select(F.col("go_id").alias("_g"), "term", "category")
    out = counts.join(known, F.col("go_id") == F.col("_g"), "left")
    term = F.coalesce("term", F.raise_error(F.concat(F.lit("unknown term: "), "go_id")))
    return out.select("go_id", term.alias("term"), "category", "n")


def top_per_rank(profile: DataFrame, k: int) -> DataFrame:
    """The k most frequent taxa of each rank, ties by name."""
    return profile.withColumn("place", F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("n"), "taxon"))).where(F.col("place") <= k)


def by_sample(rows: DataFrame, sample: str) -> DataFrame:
    """rank, taxon, place: taxa of each rank by their count in one sample (absent: 0), ties by name."""
    own = rows.groupBy("rank", "taxon").agg(F.sum(F.when(F.col("sample") == sample, F.col("n")).otherwise(0)).alias("n"))
    return own.select("rank", "taxon", "n", F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("n"), "taxon")).alias("place"))


def first_file_wins(rows: DataFrame, read: str = "read", priority: str = "priority") -> DataFrame:
    """One row a read: that of the lowest priority number. All columns go through one aggregate."""
    rest = [c for c in rows.columns if c not in (read, priority)]
    return rows.groupBy(read).agg(F.min(F.struct(priority, *rest)).alias("r")).select(read, *[f"r.{c}" for c in rest])


def best_evalue_wins(rows: DataFrame, read: str = "read", evalue: str = "evalue", file: str | None = None) -> DataFrame:
    """One row a read: that of the least positive e-value below 100000; reads without one are left out.

    With a column `file`, a read that occurs twice in one file raises. Files are few, reads are never gathered.
    """
    rest = [c for c in rows.columns if c not in (read, evalue)]
    value = F.expr(f"try_cast({evalue} as double)")
    good = F.when((F.col("_e") > 0) & (F.col("_e") < 100000), F.struct("_e", *rest, evalue))
    found = F.min(good).alias("r")
    if not file:
        out = rows.withColumn("_e", value).where("_e > 0 and _e < 100000").groupBy(read).agg(found)
    else:
        twice = F.raise_error(F.concat(F.lit("twice in one file: "), F.col(read).cast("string"))).cast("boolean")
        out = rows.withColumn("_e", value).groupBy(read).agg(found, F.count(F.lit(1)).alias("_n"), F.size(F.collect_set(file)).alias("_files"))
        out = out.where(F.when(F.col("_n") == F.col("_files"), F.col("r").isNotNull()).otherwise(twice))
    return out.select(read, *[f"r.{c}" for c in rest], f"r.{evalue}")


def read_of(name):
    """A read's name without the frame and strand that a search adds."""
    return F.regexp_replace(name, r"_[+-]?\d_[+-]?\d$", "")
