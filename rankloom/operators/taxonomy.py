"""Closure over a parent-pointer taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.operators.cut import checkpointed


def with_merged(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """Adds merged ids (old_id, new_id): an old id takes parent and rank of the new one."""
    return nodes.unionByName(merged.join(nodes, F.col("new_id") == F.col("taxid")).select(F.col("old_id").alias("taxid"), "parent", "rank"))


def lineages(nodes: DataFrame) -> DataFrame:
    """taxid, rank, path (root first) of every node that reaches the root, however deep; a cycle raises.

    Pointers are doubled: after k joins a path holds 2**k nodes, so a depth of d takes log2(d) joins. Only paths that
    have not reached the root are joined again, with all as they were before the round; a node whose path ends at
    a missing parent is left out. Each round is checkpointed, so plans stay one join deep and a lost executor costs a
    task's repetition.
    """
    step = F.when(F.col("parent") == F.col("taxid"), None).otherwise(F.col("parent"))
    rows = checkpointed(nodes.select("taxid", "rank", F.array(F.struct("taxid", "rank")).alias("path"), step.alias("top")))
    inside = F.exists("path", lambda s: s["taxid"] == F.col("top"))
    while (said := rows.where("top is not null").agg(F.count("top").alias("open"), F.bool_or(inside).alias("cycle")).first())["open"]:
        if said["cycle"]:
            raise ValueError("the taxonomy has a cycle")
        up = rows.select(F.col("taxid").alias("_t"), F.col("path").alias("_p"), F.col("top").alias("_top"))
        far = rows.where("top is not null").join(up, F.col("top") == F.col("_t"))
        far = far.select("taxid", "rank", F.concat("_p", "path").alias("path"), F.col("_top").alias("top"))
        rows = checkpointed(rows.where("top is null").unionByName(far))
    return rows.select("taxid", "rank", "path")


def with_path(rows: DataFrame, tree: DataFrame, taxid: str = "taxid", path: str = "path") -> DataFrame:
    """Adds the lineage of the column `taxid`; null where the taxonomy lacks it. Spark chooses the join by the tree's size."""
    return rows.join(tree.select(F.col("taxid").alias("_node"), F.col("path").alias(path)), F.col(taxid) == F.col("_node"), "left").drop("_node")


def lca_of_hits(hits: DataFrame) -> DataFrame:
    """query, lca: of the taxa of all hits (with path) of a query, -1 where no usable hit is left.

    Hits below the groups of other and unclassified sequences are left out. A hit of taxid 0, or of a taxon that
    the taxonomy lacks, lands on the root and makes it the result. The common beginning of the first and the last
    lineage in order is that of all, so the fold is a minimum and a maximum. For many hits see lca_by_number.
    """
    ids = F.coalesce(ranks.taxids(F.col("path")), F.array(F.lit(1)))
    usable = ~F.coalesce(F.get(ids, F.lit(1)).isin(*ranks.SKIPPED_GROUPS), F.lit(False))
    low, high = F.min(F.when(usable, ids)), F.max(F.when(usable, ids))
    folded = hits.groupBy("query").agg(low.alias("low"), high.alias("high"))
    return folded.select("query", F.when(F.col("low").isNull(), -1).otherwise(ranks.lca(F.col("low"), F.col("high"))).alias("lca"))


def numbered(tree: DataFrame) -> DataFrame:
    """tree with enter and exit of each node, and `exits`, those of all nodes of its path: a walk over the tree, parents first, numbered.

    Lineages in order are such a walk, so enter is a lineage's place: rows are dealt by ranges of their lineage,
    numbered within a range, and the ranges' sizes are added up. The subtree of a node fills the numbers from
    enter on, so exit follows from its size. No task walks the tree.
    """
    ids = ranks.taxids(F.col("path"))
    sorted_ = tree.withColumn("_ids", ids).repartitionByRange("_ids").withColumn("_part", F.spark_partition_id())
    placed = checkpointed(sorted_.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy("_ids"))).drop("_ids"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_base"))  # a row a range
    nodes = placed.join(F.broadcast(base), "_part").withColumn("enter", (F.col("_base") + F.col("_place")).cast("long")).drop("_part", "_base", "_place")
    each = nodes.select(F.col("taxid").alias("_own"), F.posexplode("path").alias("_pos", "_s")).select("_own", "_pos", F.col("_s.taxid").alias("_node"))
    size = each.groupBy("_node").agg(F.count(F.lit(1)).alias("_size"))
    nodes = nodes.join(size, F.col("taxid") == F.col("_node")).withColumn("exit", F.col("enter") + F.col("_size") - 1).drop("_node", "_size")
    ends = each.join(nodes.select(F.col("taxid").alias("_node"), "exit"), "_node").groupBy("_own").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "exit"))), lambda x: x["exit"]).alias("exits"))
    return checkpointed(nodes.join(ends, F.col("taxid") == F.col("_own")).drop("_own"))


def lca_by_number(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """query, lca of hits (query, taxid) by a numbered tree: the rows of lca_of_hits.

    A hit carries one number through the shuffle. Nodes whose numbers span the least and the greatest of a query are
    its common ancestors; they lie on the lineage of the least, which is joined once a query.
    """
    ids = ranks.taxids(F.col("path"))
    skipped = F.coalesce(F.get(ids, F.lit(1)).isin(*ranks.SKIPPED_GROUPS), F.lit(False))
    places = tree.select(F.col("taxid").alias("_node"), F.when(skipped, -1).otherwise(F.col("enter")).alias("_enter"))
    # The root's number is 1, also for taxa that the tree lacks.
    number = F.coalesce("_enter", F.lit(1).cast("long"))
    own = F.when(number > 0, number)
    folded = hits.select("query", "taxid").join(places, F.col("taxid") == F.col("_node"), "left").groupBy("query").agg(F.min(own).alias("_low"), F.max(own).alias("_high"))
    rows = folded.join(tree.select("enter", "exits", ids.alias("_ids")), F.col("_low") == F.col("enter"), "left")
    deepest = F.size(F.filter("exits", lambda e: e >= F.col("_high")))
    return rows.select("query", F.when(F.col("_low").isNull(), -1).otherwise(F.get("_ids", deepest - 1)).alias("lca"))


def ancestors(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each node of each lineage: the columns to keep, pos, ancestor, ancestor_rank."""
    return rows.select(*keep, F.posexplode("path").alias("pos", "node")).select(*keep, "pos", F.col("node.taxid").alias("ancestor"), F.col("node.rank").alias("ancestor_rank"))


def ranks_of(rows: DataFrame) -> DataFrame:
    """rows (with path) with by_rank, a map from the name of each rank of the lineage to its node; of a rank met twice the lower node counts."""
    ranked = F.filter("path", lambda s: s["rank"] != 0)
    once = F.filter(ranked, lambda s, i: ~F.exists(F.slice(ranked, i + 2, F.size(ranked)), lambda x: x["rank"] == s["rank"]))
    return rows.withColumn("by_rank", F.map_from_entries(F.transform(once, lambda s: F.struct(ranks.rank_name(s["rank"]), s["taxid"]))))


def excluded(rows: DataFrame, taxa: list[int], tree: DataFrame, rank: int) -> DataFrame:
    """rows (with path) not below the ancestors, at the given rank, of the listed taxa."""
    held = tree.where(F.col("taxid").isin(taxa)).select(ranks.taxon_at_rank(F.col("path"), F.lit(rank)).alias("bad")).where("bad <> 0").distinct()
    found = held.agg(F.collect_set("bad").alias("bad"))  # as many as are listed, at most
    return rows.join(F.broadcast(found)).where(~F.arrays_overlap(ranks.taxids(F.filter("path", lambda s: s["rank"] >= rank)), "bad")).drop("bad")


def specific(path: Column, genus_name: Column | None = None) -> Column:
    """Whether a taxon's lowest rank is species or below, with a true phylum and a true genus that is not called environmental samples."""
    has = lambda r: F.exists(path, lambda s: s["rank"] == r)
    out = (ranks.lowest_rank(path) >= 27) & has(5) & has(23)
    return out if genus_name is None else out & ~F.coalesce(genus_name == "environmental samples", F.lit(False))


def named_genus(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds genus_name, the name (taxid, name) of the lineage's genus."""
    genus = F.get(F.filter("path", lambda s: s["rank"] == 23), F.lit(0))["taxid"]
    return rows.withColumn("_genus", genus).join(names.select(F.col("taxid").alias("_genus"), F.col("name").alias("genus_name")), "_genus", "left").drop("_genus")
