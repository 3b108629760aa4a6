"""Text forms of results. Write them with DataFrame.write.text: Spark's committer makes files whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.ranks import RANKS
from rankloom.operators.taxonomy import ancestors


def classification_lines(rows: DataFrame, names: DataFrame) -> DataFrame:
    """line of rows (query, property, go, taxid, path, evalue): the path as lower-case names joined by '!', unknown for taxid 1 or less."""
    known = names.select(F.col("taxid").alias("ancestor"), "name")
    used = ancestors(rows.select("taxid", "path").distinct(), "taxid").join(known, "ancestor", "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("unknown")).alias("name"))))
    paths = used.groupBy("taxid").agg(F.array_join(F.transform(listed, lambda s: s["name"]), "!").alias("names"))
    out = rows.join(paths, "taxid", "left")
    path = F.when((F.col("taxid") <= 1) | F.col("names").isNull(), "unknown").otherwise(F.col("names"))
    return out.select(F.concat_ws("\t", "query", "property", "go", F.col("taxid").cast("string"), path, "evalue").alias("line"))


def fasta_records(rows: DataFrame, *keep: str) -> DataFrame:
    """record of rows (header, seq)."""
    return rows.select(*keep, F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("record"))


def translation_records(rows: DataFrame) -> DataFrame:
    """record of translated reads (query, seq): the header has a blank before the query."""
    return rows.select(F.concat(F.lit("> "), "query", F.lit("\n"), "seq").alias("record"))


def profile_lines(rows: DataFrame) -> DataFrame:
    """line of a profile (rank, taxon, n), the taxon in quotes; by rank, falling n and taxon, by ranges, so that files follow each other."""
    order = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("rank"))
    text = F.concat(F.col("rank"), F.lit('\t"'), F.col("taxon"), F.lit('"\t'), F.col("n").cast("string"))
    return rows.orderBy(order, F.desc("n"), "taxon").select(text.alias("line"))


def comparative_lines(rows: DataFrame, samples: list[str], absolute: bool = False) -> DataFrame:
    """line of a wide comparative profile (rank, taxon, a column a sample): counts, or shares with four digits and a bare 0 where there is none."""
    order = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("rank"))
    cell = lambda s: F.col(f"`{s}`").cast("string") if absolute else F.when(F.col(f"`{s}`") == 0, "0").otherwise(F.format_string("%.4f", F.col(f"`{s}`")))
    cells = [cell(s) for s in samples]
    return rows.orderBy(order, F.desc(F.col(f"`{samples[0]}`")), "taxon").select(F.concat_ws("\t", "rank", F.concat(F.lit('"'), "taxon", F.lit('"')), *cells).alias("line"))


def filtered_lines(rows: DataFrame, samples: list[str]) -> DataFrame:
    """rank, count_line and share_line of filtered_away: a share has four digits, `--` where no read stays."""
    share = lambda s: F.coalesce(F.format_string("%.4f", F.col(f"`{s}_share`")), F.lit("--"))
    shares = [F.when(F.col(f"`{s}_share`").isNull(), "--").otherwise(share(s)) for s in samples]
    return rows.select("rank", F.concat_ws("\t", "rank", *[F.col(f"`{s}`").cast("string") for s in samples]).alias("count_line"), F.concat_ws("\t", "rank", *shares).alias("share_line"))


def functional_lines(rows: DataFrame, category: str | None = None) -> DataFrame:
    """line of a functional profile (go_id, term, category, n), of one category or all, by falling n and id."""
    chosen = rows if category is None else rows.where(F.col("category") == category)
    return chosen.orderBy(F.desc("n"), "go_id").select(F.concat_ws("\t", "go_id", F.concat(F.lit('"'), "term", F.lit('"')), F.col("n").cast("string")).alias("line"))


def write_families(rows: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Writes sequences (family, header, seq) as FASTA text, a folder `family=...` each, of files of about `per_file` records.

    Families are counted first; a large one is cut into as many parts as it needs, by a hash of the header, so no task
    writes a family alone. Within a part records go by header.
    """
    parts = rows.groupBy(F.col("family").alias("_family")).agg(F.ceil(F.count(F.lit(1)) / per_file).cast("int").alias("_parts"))
    dealt = rows.join(parts, F.col("family").eqNullSafe(F.col("_family"))).drop("_family")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("header"), F.col("_parts")))
    dealt = dealt.repartition("family", "_part").sortWithinPartitions("family", "_part", "header")
    fasta_records(dealt, "family").write.partitionBy("family").option("maxRecordsPerFile", per_file).text(path)
