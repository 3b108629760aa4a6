"""Ranks of the taxonomy and functions on lineages.

A lineage is array<struct<taxid int, rank int>> from the root down to the node itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rank names in the order of their ids.
RANKS = [
    "no rank", "superkingdom", "kingdom", "subkingdom", "superphylum", "phylum", "subphylum", "superclass", "class", "subclass",
    "infraclass", "cohort", "subcohort", "superorder", "order", "suborder", "infraorder", "parvorder", "superfamily", "family",
    "subfamily", "tribe", "subtribe", "genus", "subgenus", "species group", "species subgroup", "species", "subspecies", "varietas", "forma",
]
# Least rank id of each simple rank, 0 (species or below) to 6 (superkingdom); 7 is none.
SIMPLE = [27, 23, 19, 14, 8, 5, 1]
#: The rank id that stands for a simple rank.
RANK_OF_SIMPLE = [27, 23, 19, 14, 8, 5, 1, 0]
# Taxa of unclassified and other sequences, and the groups whose hits are kept.
SKIPPED_GROUPS = (28384, 12908)
KEPT_GROUPS = (2157, 2, 2759, 12884, 10239)
CELLULAR = 131567


def rank_id(name: Column) -> Column:
    """Id of a rank name; an unknown name raises."""
    names = F.array(*[F.lit(r) for r in RANKS])
    at = F.array_position(names, name)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("unknown rank: "), name)).cast("long")).cast("int")


def rank_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in RANKS]), rank)


def simple_rank(rank: Column) -> Column:
    out = F.lit(7)
    for k, least in reversed(list(enumerate(SIMPLE))):
        out = F.when(rank >= least, k).otherwise(out)
    return out


def taxids(path: Column) -> Column:
    return F.transform(path, lambda s: s["taxid"])


def packed(path: Column) -> Column:
    """A lineage in few bytes: for each node a long of its taxid, its rank id and the simple rank of the lineage that ends there.

    Two taxa share what their packed lineages share, and the last shared number tells the simple rank of their common ancestor.
    """
    simple = F.array(*[F.lit(next((k for k, least in enumerate(SIMPLE) if r >= least), 7)) for r in range(len(RANKS))])
    lowest = F.transform(path, lambda s, i: lowest_rank(F.slice(path, F.lit(1), i + 1)))
    return F.transform(F.arrays_zip(path.alias("s"), lowest.alias("low")), lambda x: F.shiftleft(x["s"]["taxid"].cast("long"), 8) + x["s"]["rank"] * 8 + F.get(simple, x["low"]))


def unpacked(line: Column) -> Column:
    """The lineage of a packed one."""
    return F.transform(line, lambda x: F.struct(F.shiftright(x, 8).cast("int").alias("taxid"), F.shiftright(x, 3).bitwiseAND(31).cast("int").alias("rank")))


def packed_taxid(line: Column, place: int) -> Column:
    """taxid of the node at a place (from 0) of a packed lineage; null beyond its end."""
    return F.shiftright(F.get(line, F.lit(place)), 8).cast("int")


def shared_simple_rank(a: Column, b: Column) -> Column:
    """Simple rank of the common ancestor of two packed lineages, 7 (none) where one is null."""
    return F.coalesce(F.get(a, F.size(F.array_intersect(a, b)) - 1).bitwiseAND(7).cast("int"), F.lit(7))


def lca(a: Column, b: Column) -> Column:
    """Deepest common node of two lineages' taxids, 0 if none: in a tree the common nodes are a common beginning."""
    return F.coalesce(F.get(a, F.size(F.array_intersect(a, b)) - 1), F.lit(0))


def common_length(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def lowest_rank(path: Column) -> Column:
    """Rank of the nearest node, upwards from the last, that has one; else 0."""
    ranked = F.filter(path, lambda s: s["rank"] != 0)
    return F.coalesce(F.get(ranked, F.size(ranked) - 1)["rank"], F.lit(0))


def taxon_at_rank(path: Column, rank: Column) -> Column:
    """The node of just this rank; if a smaller one is met first on the way up, the last ranked node below that; else 0."""
    ranked = F.filter(path, lambda s: s["rank"] != 0)
    above = F.filter(ranked, lambda s: s["rank"] <= rank)
    below = F.filter(ranked, lambda s: s["rank"] > rank)
    nearest = F.get(above, F.size(above) - 1)
    return F.when(nearest.isNull(), 0).when(nearest["rank"] == rank, nearest["taxid"]).otherwise(F.coalesce(F.get(below, F.lit(0))["taxid"], F.lit(0)))


def reduce_by_rank(path: Column, rank: Column) -> Column:
    """The lineage cut after its lowest node of at most this rank, ranks rising from the root; taxid of that node, else -1."""
    start = F.struct(F.lit(0).alias("rank"), F.lit(-1).alias("taxid"))
    rises = lambda acc, s: (s["rank"] > 0) & (s["rank"] <= rank) & (s["rank"] > acc["rank"]) & (acc["rank"] != rank)
    step = lambda acc, s: F.struct(F.when(rises(acc, s), s["rank"]).otherwise(acc["rank"]).alias("rank"), F.when(rises(acc, s), s["taxid"]).otherwise(acc["taxid"]).alias("taxid"))
    return F.aggregate(F.slice(path, F.lit(2), F.size(path)), start, step)["taxid"]


def least_rank_for(length: Column, identity: Column, gaps: Column, positives_more: Column) -> Column:
    """The deepest rank that an alignment supports, from its length, percent identity, gaps and positives beyond identities; null: none."""
    def table(*rows):
        out = F.lit(None).cast("int")
        for cond, rank in reversed(rows):
            out = F.when(cond, rank).otherwise(out)
        return out

    i, d = identity, positives_more
    species, genus, family, order, klass, phylum = 27, 23, 19, 14, 8, 5
    huge = table(((i >= 90) & (gaps == 0) & (d == 0), species), (i >= 90, genus), ((i >= 75) & (d <= 2), genus), (i >= 75, family), (i >= 60, klass), (i >= 45, phylum))
    large = table(((i >= 65) & (d <= 6), genus), (i >= 65, family), (i >= 60, family), (i >= 55, order), (i >= 50, klass), (i >= 35, phylum))
    middle = table(((i >= 65) & (d <= 6), genus), (i >= 65, family), (i >= 60, family), (i >= 55, order), (i >= 50, klass), (i >= 45, phylum))
    small = table(((i >= 65) & (d <= 1), genus), (i >= 65, family), (i >= 50, phylum))
    return F.when(length >= 550, huge).when(length >= 350, large).when(length >= 150, middle).otherwise(small)
