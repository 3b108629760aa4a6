"""Taxa from descriptions, and what 16S preparation makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.operators import taxonomy as T


def _beginnings(words: Column) -> Column:
    """A text, given as its words, less its last word, less its last two, and so on."""
    n = F.size(words)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(words, 1, n - k), " "))).otherwise(F.array().cast("array<string>"))


def _last(text: Column, mark: str) -> Column:
    """Place (from 1) of the last such character, 0 if there is none."""
    return F.when(F.contains(text, F.lit(mark)), F.length(text) - F.instr(F.reverse(text), F.lit(mark)) + 1).otherwise(0)


def _bracketed(text: Column) -> Column:
    """What stands in the last balanced pair of square brackets; null if the last one is not balanced."""
    before = F.substring(text, F.lit(2), _last(text, "]") - 2)
    start = F.struct(F.lit(1).alias("height"), F.lit(0).alias("seen"))

    def step(s: Column, c: Column) -> Column:
        height = s["height"] + F.when(c == "]", 1).when(c == "[", -1).otherwise(0)
        return F.when(s["height"] == 0, s).otherwise(F.struct(height.alias("height"), (s["seen"] + 1).alias("seen")))

    found = F.aggregate(F.split(F.reverse(before), ""), start, step)
    nested = F.when(found["height"] == 0, F.substring(before, F.length(before) - found["seen"] + 2, found["seen"] - 1))
    # Letters are walked only where brackets stand within brackets.
    inner = F.substring_index(before, "[", -1)
    return F.when(F.contains(before, F.lit("[")) & ~F.contains(inner, F.lit("]")), inner).otherwise(F.when(F.contains(before, F.lit("[")), nested))


def organism_text(header: Column) -> Column:
    """What of a description line decides its candidates: of lines with square brackets the last pair, a line of its own, else the line; null if nothing does."""
    return F.when(F.startswith(header, F.lit(">pir|")) | ~F.contains(header, F.lit("]")), header).otherwise(F.concat(F.lit(">["), _bracketed(header), F.lit("]")))


def with_candidates(rows: DataFrame, header: Column, out: str = "candidates") -> DataFrame:
    """Adds the names that a description line may mean, the most likely first, in lower case.

    Lines of `>pir|` give what follows " - ", then what stands in the last round brackets, then the text without
    these brackets and the word strain, then its beginnings. Other lines give what stands in the last square
    brackets, or what of it precedes a comma; without such brackets what follows " from ", then beginnings.

    Each step is a column of its own, so that none is worked out again wherever it is named. Explode the result with
    posexplode_outer: for the plain form the optimiser puts all steps, copied into each other, into a filter of its own.
    """
    c, keep = F.col, rows.columns
    after = lambda s, mark: F.when(F.contains(s, F.lit(mark)), F.substring(s, F.instr(s, F.lit(mark)) + len(mark), F.lit(1 << 30)))
    cut = lambda s, at: F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.lit(1 << 30)))
    once = lambda s, word: F.when(F.contains(s, F.lit(word)), F.concat(F.substring(s, F.lit(1), F.instr(s, F.lit(word)) - 1), after(s, word))).otherwise(s)
    rows = rows.withColumn("_h", header)
    rows = rows.withColumns({"_low": F.lower("_h"), "_name": F.lower(after(c("_h"), " - "))})
    rows = rows.withColumns({"_open": _last(c("_name"), "("), "_close": _last(c("_name"), ")"), "_source": after(c("_low"), " from "), "_words": F.split(after(c("_low"), " "), " ")})
    far, near = F.greatest("_open", "_close"), F.least("_open", "_close")
    rows = rows.withColumn("_bare", cut(cut(c("_name"), far), near)).withColumn("_bare", once(c("_bare"), ", substrain")).withColumn("_bare", F.regexp_replace(once(c("_bare"), "strain"), " {2,}", " "))
    rows = rows.withColumns({"_inside": F.substring(c("_name"), c("_open") + 1, c("_close") - c("_open") - 1), "_bare_words": F.split("_bare", " "), "_name_words": F.split("_name", " ")})
    rows = rows.withColumn("_square", F.when(F.contains("_h", F.lit("]")), F.lower(_bracketed(c("_h")))))
    none = F.array().cast("array<string>")
    pir = F.when((c("_open") > 0) & (c("_close") > 0), F.concat(F.array("_name", "_inside", "_bare"), _beginnings(c("_bare_words")))).otherwise(F.concat(F.array("_name"), _beginnings(c("_name_words"))))
    loose = F.concat(F.array("_source"), F.coalesce(_beginnings(c("_words")), none))
    boxed = F.array(c("_square"), F.substring_index("_square", ",", 1))
    found = F.when(F.startswith("_h", F.lit(">pir|")), pir).when(F.contains("_h", F.lit("]")), boxed).otherwise(loose)
    return rows.withColumn("_found", found).select(*keep, F.filter(F.coalesce("_found", none), lambda x: x.isNotNull()).alias(out))


def organism_taxid(rows: DataFrame, key: str, header: str, names: DataFrame) -> DataFrame:
    """key, taxid of each description: the first of its candidates that is a name (name, taxid), 0 if none is."""
    wide = with_candidates(rows.select(key, header), F.col(header)).select(key, F.posexplode_outer("candidates").alias("_at", "name"))
    found = wide.join(names, "name").groupBy(key).agg(F.min_by("taxid", "_at").alias("taxid"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("taxid", F.lit(0)).alias("taxid"))


def id_to_taxid(rows: DataFrame) -> DataFrame:
    """id, taxid of rows (id, taxid); a repeated id raises."""
    per = rows.groupBy("id").agg(F.first("taxid").alias("taxid"), F.count(F.lit(1)).alias("n"))
    return per.select("id", F.when(F.col("n") == 1, F.col("taxid")).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), "id")).cast("int")).alias("taxid"))


def record_taxa(headers: DataFrame, names: DataFrame) -> DataFrame:
    """id, taxid of 16S headers (id, organism) by their organism's name (name, taxid), 0 without one; a repeated id raises."""
    known = names.select("name", F.col("taxid").alias("_taxid"))
    rows = headers.select("id", F.lower("organism").alias("name")).join(known, "name", "left")
    return id_to_taxid(rows.select("id", F.coalesce("_taxid", F.lit(0)).alias("taxid")))


def without_gap_columns(rows: DataFrame, column: str = "aligned", least_width: int = 0) -> DataFrame:
    """rows with the columns taken out that are a gap in every row that reaches them.

    Columns with a residue are found by an aggregate that combines before the shuffle; their number is at most
    the alignment's width, so the set is sent to all tasks.
    """
    wide = rows.select(F.posexplode(F.split(column, "")).alias("pos", "c"))
    used = wide.groupBy("pos").agg(F.bool_or(~F.col("c").isin("-", ".")).alias("used")).where("used").agg(F.array_sort(F.collect_list("pos")).alias("_used"))
    letters = F.split(F.col(column), "")
    kept = F.array_join(F.transform(F.col("_used"), lambda p: F.coalesce(F.get(letters, p), F.lit(""))), "")
    return rows.join(F.broadcast(used)).withColumn(column, kept).drop("_used")


def specific_records(rows: DataFrame, tree: DataFrame, names: DataFrame, left_out: list[int], rank: int) -> DataFrame:
    """record, id, taxid of aligned sequences (id, taxid, aligned) of specific taxa not below the ancestors of the listed ones; all-gap columns are taken out.

    A record is `>id_taxid OFFSETn` and the row without its outer gaps, n of which stood before it. A row of gaps
    alone and a repeated id raise.
    """
    kept = T.with_path(rows, tree).where(F.col("path").isNotNull())
    kept = T.named_genus(kept, names).where(T.specific(F.col("path"), F.col("genus_name"))).drop("genus_name")
    if left_out:
        kept = T.excluded(kept, left_out, tree, rank)
    once = kept.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    kept = without_gap_columns(kept).join(once, "id")
    inner = F.regexp_replace("aligned", "^-+|-+$", "")
    offset = F.length("aligned") - F.length(F.regexp_replace("aligned", "^-+", ""))
    name = F.when(F.col("_n") == 1, F.col("id")).otherwise(_error("repeated id: ", F.col("id")))
    body = F.when(inner != "", inner).otherwise(_error("gaps alone: ", F.col("id")))
    return kept.select(F.concat(F.lit(">"), name, F.lit("_"), F.col("taxid").cast("string"), F.lit(" OFFSET"), offset.cast("string"), F.lit("\n"), body).alias("record"), "id", "taxid")


# Ranks that the lineages of a 16S training set hold, and the superkingdoms right below its root.
TRAINED_RANKS = (1, 5, 8, 14, 19, 23)
SUPERKINGDOMS = (2, 2157, 2759)


def _error(text: str, *parts: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text), *[x.cast("string") for x in parts])).cast("string")


def _trained(path: Column) -> Column:
    return F.filter(path, lambda s: s["rank"].isin(*TRAINED_RANKS))


def training_records(rows: DataFrame, tree: DataFrame, names: DataFrame) -> DataFrame:
    """record, id of sequences (id, taxid, seq): `>id 1_root;taxid_name;...` over the trained ranks, and the sequence.

    Lineages are written once a taxon before they meet the sequences. A taxon that the taxonomy lacks, or a
    lineage with a node without a name, raises.
    """
    taxa = T.with_path(rows.select("taxid").distinct(), tree)
    each = T.ancestors(taxa.where("taxid > 1"), "taxid").where("ancestor > 1").join(names.select(F.col("taxid").alias("ancestor"), "name"), "ancestor", "left")
    name = F.coalesce("name", _error("no name of taxon ", F.col("ancestor")))
    part = F.struct("pos", F.col("ancestor_rank").isin(*TRAINED_RANKS).alias("trained"), F.concat(F.col("ancestor").cast("string"), F.lit("_"), name).alias("text"))
    listed = F.filter(F.array_sort(F.collect_list(part)), lambda s: s["trained"])
    lineage = each.groupBy("taxid").agg(F.array_join(F.transform(listed, lambda s: s["text"]), ";").alias("_lineage"))
    text = F.when(F.col("taxid") <= 1, "").otherwise(F.coalesce("_lineage", _error("unknown taxon ", F.col("taxid"))))
    return rows.join(lineage, "taxid", "left").select(F.concat(F.lit(">"), "id", F.lit(" 1_root;"), text, F.lit("\n"), "seq").alias("record"), "id")


def training_taxa(rows: DataFrame, tree: DataFrame, names: DataFrame) -> DataFrame:
    """taxid, line for the root and each trained node above the taxa of rows: `taxid*taxid_name*parent*depth*rank`.

    The parent is the nearest trained node above, 1 for a superkingdom of cellular organisms; any other node
    without one raises, and so does a node without a name.
    """
    def entry(used: Column, s: Column, i: Column) -> Column:
        above = F.when(s["taxid"].isin(*SUPERKINGDOMS), 1).when(i > 0, F.get(used, i - 1)["taxid"])
        return F.struct(s["taxid"].alias("taxid"), s["rank"].alias("rank"), above.alias("parent"), (i + 1).alias("depth"))

    taxa = T.with_path(rows.select("taxid").distinct(), tree).select(_trained(F.col("path")).alias("used"))
    nodes = taxa.select(F.explode(F.transform("used", lambda s, i: entry(F.col("used"), s, i))).alias("e")).select("e.*").distinct()
    named = nodes.join(names.select("taxid", "name"), "taxid", "left")
    taxid = F.col("taxid").cast("string")
    name = F.concat(taxid, F.lit("_"), F.coalesce("name", _error("no name of taxon ", F.col("taxid"))))
    parent = F.coalesce(F.col("parent").cast("string"), _error("no trained node above taxon ", F.col("taxid")))
    lines = named.select("taxid", F.concat_ws("*", taxid, name, parent, F.col("depth").cast("string"), ranks.rank_name(F.col("rank"))).alias("line"))
    root = rows.sparkSession.range(1).select(F.lit(1).alias("taxid"), F.lit("1*1_root*0*0*norank").alias("line"))
    return root.unionByName(lines)
