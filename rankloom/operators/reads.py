"""Modes on search results: from the hits of all reads, and the search of their best hits, to a taxon for each read.

A read's hits are filtered by the limits of its match type, then by shares of the best score: the narrowest share
counts whose result has a worse hit to hold against. All shares are worked out together. A hit's level is the first
share that keeps it, so one window and one aggregate by query give the counts of every share, and one aggregate over
the other scores of the reciprocal search gives every share's intervals.

The reciprocal relation is what a search of the best hit among the query and the hits found: rows (query, kind, taxid,
score, ord) of kind `self`, `query`, `other` (a hit, by its taxon) or `low` (an other below the bit score limit). Hits
carry their lineages packed into a long a node, so ranks of common ancestors need no further join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.operators import classify as C
from rankloom.operators import hits as H
from rankloom.operators import organisms as G
from rankloom.operators.cut import drop, written
from rankloom.sources import parsers as P

# Match type by the kind of the input (n: nucleotides, p: proteins) and of the database (r: 16S).
MATCH_TYPES = {("n", "p"): "BLASTX", ("n", "n"): "BLASTN", ("n", "r"): "BLASTN", ("p", "p"): "BLASTP"}
# Most e-value, least bit score, least alignment length.
LIMITS = {"BLASTX": (1e8, 35.0, 25), "BLASTP": (1e8, 35.0, 25), "BLASTN": (1e8, 0.0, 0)}
#: Shares of the best score, in the order in which they are tried.
SHARES = (0.1, 0.3, 0.6, 1.0)


def match_type(kind: str, database: str) -> str:
    """The match type of an input kind (n, p) against a database (n, p, r); other pairs raise."""
    if (kind, database) not in MATCH_TYPES:
        raise ValueError(f"no search of type {kind!r} against database {database!r}")
    return MATCH_TYPES[kind, database]


def tabular_rows(lines: DataFrame, taxa: DataFrame | None = None) -> DataFrame:
    """Hits of tabular lines (ord, value) with comments; a query's comment has a row of its own, without ord, so queries without hits are there too.

    Of a subject's neighbouring rows the first counts. Taxa come from `taxa` (subject, taxid; 0 where it lacks one)
    or, without it, from subjects `id_taxid`; another number of underscores raises.
    """
    asked = F.regexp_extract("value", r"^# Query:\s*(\S+)", 1)
    comment = F.startswith("value", F.lit("#"))
    rows = P.blast_m8_cells(lines.where((F.trim("value") != "") & (~comment | F.startswith("value", F.lit("# Query:")))), comment)
    rows = rows.select(F.when(comment, asked).otherwise(F.col("query")).alias("query"), F.when(~comment, F.col("ord")).alias("ord"), "subject", F.col("bitscore").alias("score"), F.col("evalue").alias("ev"), "aln_len")
    if taxa is None:
        parts = F.split("subject", "_")
        bad = F.raise_error(F.concat(F.lit("no taxon in subject: "), "subject")).cast("int")
        taxid = F.when(F.col("ord").isNotNull(), F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).cast("int")).otherwise(bad))
        rows = rows.withColumn("taxid", taxid)
    else:
        rows = rows.join(taxa.select("subject", F.col("taxid").alias("_taxid")), "subject", "left").withColumn("taxid", F.when(F.col("ord").isNotNull(), F.coalesce("_taxid", F.lit(0)))).drop("_taxid")
    return rows.withColumn("support", F.lit(0))


def tabular_hits(lines: DataFrame, taxa: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query) and hits of tabular lines: tabular_rows apart, the first of neighbouring rows of a subject."""
    rows = tabular_rows(lines, taxa)
    return rows.select("query").distinct(), H.collapse_consecutive(rows.where("ord is not null"), "subject")


def resolved(lists: DataFrame, names: DataFrame) -> DataFrame:
    """text, taxid and the other columns of names: of each text in lists (texts: what decides a description's candidates) the first candidate that is a name (name, taxid).

    Texts are looked up once each, however many hits have them; one without a known name is left out.
    """
    each = lists.select(F.explode("texts").alias("text")).distinct()
    wide = G.with_candidates(each, F.col("text")).select("text", F.posexplode_outer("candidates").alias("_c", "name"))
    more = [c for c in names.columns if c != "name"]
    return wide.join(names, "name").groupBy("text").agg(F.min_by(F.struct(*more), "_c").alias("_n")).select("text", "_n.*")


def report_rows(records: DataFrame, names: DataFrame) -> DataFrame:
    """Hits of report records (value), with a row without ord for each record: see report_hits.

    Other columns of names (name, taxid) are kept. Records are read once; what is left of their subjects is stored.
    """
    return _report_rows(records, names)[0]


def _report_rows(records: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = F.filter(F.transform("entries", lambda e: G.organism_text(F.concat(F.lit(">"), F.ltrim(e)))), lambda x: x.isNotNull())
    subjects = written(P.report_subjects(records).withColumn("texts", texts).drop("entries"), "subjects")
    known = resolved(subjects, names)
    carried = [c for c in known.columns if c != "text"]
    rows = subjects.where("hit is not null").select("*", F.posexplode("texts").alias("_e", "text")).drop("texts").join(known, "text")
    # A subject's first known description counts; later ones stand behind it.
    order = Window.partitionBy("query").orderBy("hit", "_e")
    rows = rows.withColumns({"_same": F.lag("hit").over(order), "_before": F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.where(~F.col("hit").eqNullSafe(F.col("_same")))
    support = ranks.least_rank_for(F.abs(F.col("q_start") - F.col("q_end")), F.col("percent"), F.col("gaps"), F.col("positives") - F.col("identities"))
    front = F.col("first") > F.coalesce("_before", F.lit(-10000.0))
    place = F.when(front, -F.col("hit")).otherwise(F.col("hit")).cast("long")
    hits = rows.select("query", place.alias("ord"), *carried, F.col("bitscore").alias("score"), F.col("evalue").alias("ev"), "aln_len", F.coalesce(support, F.lit(0)).alias("support"), "q_seq")
    return hits.unionByName(subjects.where("coalesce(hit, 0) = 0").select("query"), allowMissingColumns=True), subjects


def written_report_rows(records: DataFrame, names: DataFrame) -> DataFrame:
    """The same, stored for those who read them twice."""
    rows, subjects = _report_rows(records, names)
    out = written(rows, "hits")
    drop(subjects)
    return out


def report_hits(records: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query) and hits of report records (value): subjects whose descriptions name no taxon are left out.

    A subject counts by its best alignment, whose letters of the query are q_seq. A subject that beats all alignments
    before it goes to the front.
    """
    rows = written_report_rows(records, names)
    return rows.select("query").distinct(), rows.where("ord is not null")


def with_line(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """Adds line, the packed lineage of taxid, where there is none yet."""
    if "line" in rows.columns:
        return rows
    key = F.coalesce("taxid", -1 - F.pmod(F.hash("query"), F.lit(1 << 20)))  # rows without a taxon are spread
    return rows.join(packed_tree(tree).withColumnRenamed("taxid", "_node"), key == F.col("_node"), "left").drop("_node")


def packed_tree(tree: DataFrame) -> DataFrame:
    """taxid, line: the packed lineages of a tree."""
    return tree.select("taxid", ranks.packed(F.col("path")).alias("line"))


def levels(rows: DataFrame, limits: tuple, shares: tuple[float, ...], hit: Column) -> DataFrame:
    """Adds usable, level (place of the first share that keeps the hit) and exhausted (of the first that keeps all of its query) to hits with line.

    Usable are hits before the first beyond the limits of e-value and score, long enough and of a kept group. Rows that
    are no hits have places behind them in `place` and none of the three.
    """
    ev, score, length = limits
    group = (ranks.packed_taxid(F.col("line"), 0) == 1) & ranks.packed_taxid(F.col("line"), 2).isin(*ranks.KEPT_GROUPS)
    fails, own = (F.col("ev") > ev) | (F.col("score") < score), F.when(hit, F.col("score"))
    so_far = Window.partitionBy("query").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_tail": F.max(F.when(hit, fails.cast("int"))).over(so_far), "_low": F.min(own).over(so_far), "_best": F.max(own).over(H.whole()), "_least": F.min(own).over(H.whole())})

    def first(value: Column) -> Column:
        out = F.lit(len(shares))
        for k in reversed(range(len(shares))):
            out = F.lit(k) if shares[k] == 1 else F.when(value >= (1 - shares[k]) * F.col("_best"), k).otherwise(out)
        return out

    all_in = F.lit(len(shares))
    for k in reversed(range(len(shares))):
        all_in = F.when(F.col("_least") >= (1 - shares[k]) * F.col("_best"), k).otherwise(all_in)
    usable = hit & (F.col("_tail") == 0) & (F.col("aln_len") >= length) & F.coalesce(group, F.lit(False))
    return rows.withColumns({"usable": usable, "level": F.when(hit, first(F.col("_low"))), "exhausted": F.when(hit, all_in)}).drop("_tail", "_low", "_best", "_least")


def classify_blast(queries: DataFrame, hits: DataFrame, reciprocal: DataFrame, tree: DataFrame, kind: str, database: str, limits: dict | None = None, multiplier: float = 1.0, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """query, property, taxid, evalue, share of every query: how it was classified, and by which share of the best score.

    hits: query, ord, taxid, score, ev, aln_len, support (the rank that the alignment supports, 0: none); see
    tabular_hits and report_hits. Reports (type n against p) try the shares in turn and stop where all hits are in;
    tabular results know no best score, so all their hits count. evalue is the first usable hit's, null if there is none.
    """
    wanted = queries.select("query").withColumn("ord", F.lit(None).cast("long"))
    return classify_rows(hits.where("ord is not null").unionByName(wanted, allowMissingColumns=True), reciprocal, tree, kind, database, limits, multiplier, shares)


def classify_rows(rows: DataFrame, reciprocal: DataFrame, tree: DataFrame, kind: str, database: str, limits: dict | None = None, multiplier: float = 1.0, shares: tuple[float, ...] = SHARES, collapse: bool = False) -> DataFrame:
    """The same of hits among which each query has a row without ord, as tabular_rows and report_rows give them; with `collapse`, for rows of tables, any hit makes a query and the first of a subject's neighbouring rows counts.

    Hits and the reciprocal relation are put together by query once; all that follows are windows and one aggregate
    there. A hit carries its lineage packed, from which the rank of its common ancestor with the best hit follows.
    """
    match = match_type(kind, database)
    tabular = match != "BLASTX"
    shares = (1.0,) if tabular else shares
    chosen, steps = LIMITS | (limits or {}), range(len(shares))
    rows = with_line(rows, tree).withColumn("_kind", F.when(F.col("ord").isNull(), "asked").otherwise("hit"))
    columns = ["query", "_kind", F.col("ord").cast("long").alias("ord"), "taxid", F.col("score").cast("double").alias("score"), "ev", "aln_len", "support", "line", *(["subject"] if collapse else [])]
    found = reciprocal.select("query", F.col("kind").alias("_kind"), F.col("ord").cast("long").alias("ord"), "taxid", F.col("score").cast("double").alias("score"))
    rows = rows.select(*columns).unionByName(found, allowMissingColumns=True).where(F.col("query").isNotNull() | (F.col("_kind") == "asked"))
    hit = F.col("_kind") == "hit"
    rows = rows.withColumn("place", F.struct((~hit).cast("int"), "ord"))
    if collapse:
        before = F.lag("subject").over(Window.partitionBy("query").orderBy("place"))
        rows = rows.withColumn("_before", before).where(~hit | ~F.col("subject").eqNullSafe(F.col("_before"))).drop("subject", "_before")
    rows = levels(rows, H.limits_for(match, chosen["BLASTX"], chosen["BLASTP"], chosen["BLASTN"]), shares, hit)
    usable, other = F.col("usable"), (F.col("_kind") == "other") & F.col("_there").isNotNull()
    rows = rows.withColumn("best", F.min(F.when(usable, F.struct("ord", "taxid", "ev", "support", "line"))).over(H.whole()))
    # Others count from the level of the hit of their taxon on.
    taxon = Window.partitionBy("query", "taxid")
    rows = rows.withColumns({"_there": F.min(F.when(usable, F.col("level"))).over(taxon), "_line": F.max(F.when(hit, F.col("line"))).over(taxon)})
    rows = rows.withColumn("_r", F.when(other, ranks.shared_simple_rank(F.col("best.line"), F.col("_line"))))
    last = lambda kind: F.max_by(F.when(F.col("_kind") == kind, F.col("score")), F.when(F.col("_kind") == kind, F.col("ord")))
    own, asked, searched = last("self"), last("query"), ~F.col("_kind").isin("hit", "asked")
    if tabular:
        missing = F.raise_error(F.concat(F.lit("no self in the reciprocal search of "), F.col("query").cast("string"))).cast("double")
        own = F.coalesce(own, F.when(F.count_if(searched) > 0, missing))
        asked = F.coalesce(asked, F.min(F.when(searched, F.col("score"))))
    aggs = [F.count_if(usable & (F.col("level") <= k)).alias(f"n_{k}") for k in steps]
    for k in steps:
        aggs.append(F.count_if(other & (F.col("_there") <= k)).alias(f"o_{k}"))
        for r in range(1, 8):
            one = F.when((F.col("_r") == r) & (F.col("_there") <= k), F.col("score"))
            aggs += [F.max(one).alias(f"b{r}_{k}"), F.min(one).alias(f"w{r}_{k}")]
    wide = rows.groupBy("query").agg(F.count_if(F.col("_kind") == "asked").alias("asked"), F.count_if(hit).alias("hits"), F.first("best").alias("best"), F.min("exhausted").alias("exhausted"), own.alias("self_score"), asked.alias("query_score"), *aggs).where("asked + hits > 0" if collapse else "asked > 0")
    step = lambda k: F.struct(F.lit(k).alias("k"), F.lit(shares[k]).alias("share"), F.when(F.col("hits") > 0, F.col(f"n_{k}")).alias("n"), F.col(f"o_{k}").alias("others"), *[F.col(f"{x}{r}_{k}").alias(f"{x}{r}") for x in "bw" for r in range(1, 8)])
    each = wide.select("query", "best", "exhausted", "self_score", "query_score", F.explode(F.array(*[step(k) for k in steps])).alias("s")).select("*", "s.*").drop("s")
    each = C.core(each, multiplier)
    each = C.held(each.withColumn("path", ranks.unpacked(F.col("best.line"))))
    each = C.held(each.withColumn("cut", F.when(F.col("rank_id") > 0, ranks.reduce_by_rank(F.col("path"), F.col("rank_id"))).otherwise(-1)))
    support = F.col("best.support")
    alone = F.greatest(ranks.reduce_by_rank(F.col("path"), support), F.lit(0)) if match != "BLASTN" else F.col("best.taxid")
    # Without a worse hit the lineage already cut is cut again.
    again = F.greatest(ranks.reduce_by_rank(F.col("path"), F.least("rank_id", support)), F.lit(0))
    state = F.when(F.col("n").isNull(), "no_hits").when(F.col("n") == 0, "no_hits2").when(F.col("n") == 1, "single_hit")
    state = state.when(F.col("self_score").isNull() | F.col("query_score").isNull() | (F.col("others") == 0), "not_possible")
    state = state.when(F.col("cut") < 0, "no_valid_rank").otherwise(f"{C.PREFIX}_{match}")
    each = C.held(each.withColumn("property", state))
    classified = F.col("property") == f"{C.PREFIX}_{match}"
    taxid = F.when(F.col("property") == "single_hit", alone).when(classified & (F.col("cut") > 0) & F.col("no_worse"), again).when(classified, F.col("cut")).otherwise(0)
    evalue = F.when(~F.col("property").isin("no_hits", "no_hits2", "not_possible"), F.col("best.ev"))
    final_k, stopped = F.col("k") == len(shares) - 1, F.col("exhausted") <= F.col("k")
    final = F.when(F.col("property").isin("no_hits", "no_hits2"), final_k).when(F.col("property") == "single_hit", stopped | final_k).when(classified, ~F.col("no_worse") | stopped | final_k).otherwise(True)
    first = F.min(F.struct("k", "property", taxid.cast("int").alias("taxid"), evalue.alias("evalue"), "share")).alias("r")
    return each.where(final).groupBy("query").agg(first).select("query", "r.property", "r.taxid", "r.evalue", "r.share")


def best_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query, property, taxid, evalue: each query's first hit."""
    first = H.first_hit(hits, "taxid", "ev")
    return queries.join(first, "query", "left").select("query", F.when(F.col("taxid").isNull(), "no_hits").otherwise("best_hit").alias("property"), F.coalesce("taxid", F.lit(0)).alias("taxid"), F.col("ev").alias("evalue"))


def translations(classified: DataFrame, hits: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """query, seq of the queries with hits that the first share does not settle: the query's letters (q_seq) in its first hit.

    They are what a search by protein families goes on with. classified: rows of classify_blast (query, share).
    """
    first = hits.groupBy("query").agg(F.min_by("q_seq", "ord").alias("seq"))
    return classified.where(F.col("share") != shares[0]).select("query").join(first, "query")
