"""A store of sequences in blocks of letters: a region reads the blocks that it touches, however long its sequence is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import sequence as Q
from rankloom.operators import organisms as G

#: Letters of a block.
BLOCK = 4096


def stored(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, block (from 0), letters of records (id, seq). Write it once, bucketed or sorted by id, for many lookups; empty sequences have no block."""
    n = F.length("seq")
    places = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")))
    rows = records.select("id", "seq", F.explode(places).alias("block"))
    return rows.select("id", "block", F.substring("seq", F.col("block") * block + 1, F.lit(block)).alias("letters"))


def regions(store: DataFrame, wanted: DataFrame, margin: int = 0, block: int = BLOCK, strands: bool = True) -> DataFrame:
    """wanted (id, start, end, ...) with `region`: letters start to end (from 1), on the other strand where start is after end.

    With a margin so many letters more are taken on both sides, as far as there are any. Without strands start
    after end raises. An unknown id, or a region behind the sequence's end, gives null. Each interval is fetched
    once; it is joined with the blocks from its first to its last by (id, block), so a long sequence is spread over
    tasks and only thin rows are shuffled beside the blocks touched.
    """
    low, high = F.greatest(F.lit(1), F.least("start", "end") - margin), F.greatest("start", "end") + margin
    rows = wanted.withColumns({"_low": low.cast("long"), "_high": high.cast("long")})
    at = lambda place: F.floor((F.col(place) - 1) / block).cast("int")
    touched = rows.select("id", "_low", "_high").distinct().withColumn("block", F.explode(F.sequence(at("_low"), at("_high"))))
    found = touched.join(store, ["id", "block"]).groupBy("id", "_low", "_high").agg(F.array_sort(F.collect_list(F.struct("block", "letters"))).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda p: p["letters"]), "")
    first = F.get("_parts", F.lit(0))["block"].cast("long") * block
    cut = F.substring(whole, (F.col("_low") - first).cast("int"), (F.col("_high") - F.col("_low") + 1).cast("int"))
    found = found.select("id", "_low", "_high", cut.alias("_cut")).where(F.col("_cut") != "")
    out = rows.join(found, ["id", "_low", "_high"], "left")
    other: Column = Q.reverse_complement(F.col("_cut")) if strands else F.raise_error(F.concat(F.lit("start after end in "), F.col("id").cast("string"))).cast("string")
    return out.select(*wanted.columns, F.when(F.col("start") > F.col("end"), other).otherwise(F.col("_cut")).alias("region"))


def dumped(records: DataFrame, names: DataFrame) -> DataFrame:
    """gi, taxid, seq of records (header, seq) of a database dump, whose headers may list several entries.

    Each entry's number leads to the sequence. The taxon is the first entry's that names one (name, taxid), 0 without.
    """
    entries = records.withColumn("_all", F.filter(F.split("header", "(?=>gi\\|)"), lambda e: e != ""))
    each = entries.select("_all").distinct().select("_all", F.posexplode("_all").alias("_e", "_text"))
    wide = G.with_candidates(each, F.col("_text")).select("_all", "_e", F.posexplode_outer("candidates").alias("_c", "name"))
    found = wide.join(names, "name").groupBy("_all").agg(F.min_by("taxid", F.struct("_e", "_c")).alias("taxid"))
    gi = F.explode(F.transform("_all", lambda e: F.regexp_extract(e, r"^>?gi\|(\d+)\|", 1).cast("long")))
    return entries.join(found, "_all", "left").select(gi.alias("gi"), F.coalesce("taxid", F.lit(0)).alias("taxid"), "seq").where("gi is not null")
