"""Parsers of the text formats of homology search and taxonomy. Each takes lines or records as a column `value`.

Where order matters the lines come with a column `ord` (their place in the file).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.ranks import rank_id


def _fields(sep: str = r"\t\|\t") -> Column:
    return F.split(F.regexp_replace("value", r"\t\|$", ""), sep)


def nodes(lines: DataFrame) -> DataFrame:
    """taxid, parent, rank of `taxid | parent | rank |` lines; an unknown rank raises."""
    f = _fields()
    return lines.where(F.trim("value") != "").select(f[0].cast("int").alias("taxid"), f[1].cast("int").alias("parent"), rank_id(f[2]).alias("rank"))


def merged(lines: DataFrame) -> DataFrame:
    f = _fields()
    return lines.where(F.trim("value") != "").select(f[0].cast("int").alias("old_id"), f[1].cast("int").alias("new_id"))


def names(lines: DataFrame) -> DataFrame:
    """taxid, name, unique_name, class, ord."""
    f = _fields()
    return lines.where(F.trim("value") != "").select(f[0].cast("int").alias("taxid"), f[1].alias("name"), f[2].alias("unique_name"), f[3].alias("class"), "ord")


def name_to_taxid(rows: DataFrame) -> DataFrame:
    """name (lower case) to taxid over all classes; the last line wins."""
    return rows.groupBy(F.lower("name").alias("name")).agg(F.max_by("taxid", "ord").alias("taxid"))


def scientific_names(rows: DataFrame) -> DataFrame:
    """taxid to lower-case scientific name; the last line wins."""
    return rows.where("class = 'scientific name'").groupBy("taxid").agg(F.lower(F.max_by("name", "ord")).alias("name"))


def name_variants(rows: DataFrame) -> DataFrame:
    """name (lower case) to taxid of names (name, taxid, ord) and of their short forms "g. species" and "g.species".

    Lines go by ord. The first to use a name has it; a later full name is numbered `name|2`, `name|3`, a later
    short form is left out. Lines that read `environmental samples` are left out.
    """
    own = rows.where("name <> 'environmental samples'")
    at, initial = F.instr("name", " "), F.concat(F.substring("name", 1, 1), F.lit("."))
    forms = F.array(F.col("name"), *[F.when(at > 1, F.concat(initial, F.substring(F.col("name"), at + k, F.length("name")))) for k in (0, 1)])
    each = own.select("taxid", "ord", F.posexplode(F.transform(forms, F.lower)).alias("kind", "name")).where("name is not null")
    by_name = Window.partitionBy("name").orderBy("ord", "kind")
    each = each.withColumn("place", F.row_number().over(by_name)).where("place = 1 or kind = 0")
    n = F.row_number().over(by_name)
    return each.select(F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit("|"), n.cast("string"))).alias("name"), "taxid")


#: Lines of a block.
LINES = 1 << 16


def fasta(lines: DataFrame, file: str = "file") -> DataFrame:
    """file, id, description, seq: headers start records, wrapped lines are joined, blank and # lines are skipped.

    Lines of one file are ordered by ord. A line belongs to the last header before it, which is looked for within
    blocks of neighbouring lines and, before the first header of a block, in the blocks before.
    """
    clean = F.rtrim(F.regexp_replace("value", "\r", ""))
    rows = lines.select(file, "ord", clean.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.withColumn("_block", F.floor(F.col("ord") / LINES)).withColumn("_head", F.when(F.col("value").startswith(">"), F.col("ord")))
    before = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(file, "_block").agg(F.max("_head").alias("_last")).select(file, "_block", F.max("_last").over(before).alias("_carried"))
    own = F.max("_head").over(Window.partitionBy(file, "_block").orderBy("ord"))
    rows = rows.withColumn("_own", own).join(carried, [file, "_block"]).withColumn("record", F.coalesce("_own", "_carried"))
    parts = F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("ord", "value"))))
    out = rows.groupBy(file, "record").agg(F.max(F.when(F.col("value").startswith(">"), F.substring("value", 2, 1 << 30))).alias("header"), parts.alias("parts"))
    return out.where("record is not null").select(file, F.regexp_extract("header", "^[^ \t]*", 0).alias("id"), F.regexp_extract("header", "^[^ \t]*[ \t]*(.*)$", 1).alias("description"), F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("seq"))


def fasta_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, description, seq of the records of FASTA files, packed by gzip or plain.

    Spark cuts the text at each header, so plain files are read in splits and no lines are put in order. Blank
    lines and those that begin with # are skipped; what precedes the first header is left out.
    """
    chunks = spark.read.text(path, lineSep="\n>").select(F.split(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", ""), "\n").alias("_lines"))
    skipped = lambda line: (F.trim(line) == "") | line.startswith("#")
    chunks = chunks.where(F.exists("_lines", lambda line: ~skipped(line)))
    header = F.get("_lines", F.lit(0))
    body = F.filter(F.slice("_lines", F.lit(2), F.size("_lines")), lambda line: ~skipped(line))
    return chunks.select(F.regexp_extract(header, "^[^ \t]*", 0).alias("id"), F.regexp_extract(header, "^[^ \t]*[ \t]*(.*)$", 1).alias("description"), F.array_join(body, "").alias("seq"))


def fasta_by_id(records: DataFrame) -> DataFrame:
    """id, seq; a repeated id raises."""
    per = records.groupBy("id").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    return per.select("id", F.when(F.col("n") == 1, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), "id"))).alias("seq"))


#: Columns of a tabular hit.
M8 = [("query", "string"), ("subject", "string"), ("pct_identity", "double"), ("aln_len", "int"), ("mismatches", "int"), ("gap_openings", "int"), ("q_start", "int"), ("q_end", "int"), ("s_start", "int"), ("s_end", "int"), ("evalue", "double"), ("bitscore", "double")]


def blast_m8(lines: DataFrame) -> DataFrame:
    """The twelve columns of tabular hits, with ord. Surplus tabs are taken from the second column on; comment lines are left out."""
    return blast_m8_cells(lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")), F.lit(False)).drop("value")


def blast_m8_cells(lines: DataFrame, comment: Column) -> DataFrame:
    """ord, value and the twelve columns of lines, which are null in comments."""
    f = F.split("value", "\t")
    cells = F.when(~comment, F.when(F.size(f) > 12, F.concat(F.slice(f, 1, 1), F.slice(f, F.size(f) - 10, 11))).otherwise(f))
    return lines.select("ord", "value", cells.alias("c")).select("ord", "value", *[F.get("c", F.lit(k)).cast(t).alias(name) for k, (name, t) in enumerate(M8)])


def m8_queries(lines: DataFrame) -> DataFrame:
    """query of every `# Query:` comment, with or without hits."""
    return lines.where(F.col("value").startswith("# Query:")).select(F.regexp_extract("value", r"^# Query:\s*(\S+)", 1).alias("query"))


def m8_groups(lines: DataFrame) -> DataFrame:
    """The hits of one file's lines (ord, value) with group, the place of the line that begins it; a query without hits has one row of nulls.

    A group begins at a `# Query:` comment and at a hit whose query is not that of the line before, so a query that
    comes back begins another. The line before is looked for within blocks of lines and, for the first of a block, in
    the last block that has one, so no task sorts the file.
    """
    asked = F.regexp_extract("value", r"^# Query:\s*(\S+)", 1)
    named = F.when(F.startswith("value", F.lit("#")), F.when(asked != "", asked)).otherwise(F.get(F.split("value", "\t"), F.lit(0)))
    rows = lines.where(F.trim("value") != "").select("ord", "value", named.alias("query"), (asked != "").alias("_head"), F.floor(F.col("ord") / LINES).alias("_block")).where("query is not null")
    own, before = Window.partitionBy("_block").orderBy("ord"), Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_block").agg(F.max_by("query", "ord").alias("_q")).select("_block", F.last("_q").over(before).alias("_carried"))  # a row a block
    rows = rows.join(carried, "_block").withColumn("_previous", F.coalesce(F.lag("query").over(own), "_carried"))
    rows = rows.withColumn("_start", F.when(F.col("_head") | ~F.col("query").eqNullSafe(F.col("_previous")), F.col("ord")))
    started = rows.groupBy("_block").agg(F.max("_start").alias("_s")).select("_block", F.max("_s").over(before).alias("_open"))
    rows = rows.join(started, "_block").withColumn("group", F.coalesce(F.max("_start").over(own), "_open"))
    hits = blast_m8(rows.where("not _head").select(F.struct("ord", "group").alias("ord"), "value"))
    groups = rows.select("group", "query").distinct()
    cells = hits.select(F.col("ord.group").alias("group"), F.col("ord.ord").alias("ord"), *[c for c, _ in M8[1:]])
    return groups.join(cells, "group", "left")


def _kinds(rows: DataFrame, least: float, *keep: str) -> DataFrame:
    """kind (self, query, other, low), taxid and score of subjects `query`, `self` or a taxid; others below `least` are low."""
    own = F.col("subject").isin("query", "self")
    kind = F.when(own, F.col("subject")).when(F.col("bitscore") >= least, "other").otherwise("low")
    return rows.select(*keep, kind.alias("kind"), F.when(~own, F.col("subject").cast("int")).alias("taxid"), F.col("bitscore").cast("double").alias("score"))


def reciprocal_rows_m8(hits: DataFrame, least: float = 0.0) -> DataFrame:
    """group, ord, kind, taxid, score of tabular hits (group, ord, subject, bitscore); of subjects repeated in a row the first counts."""
    w = Window.partitionBy("group").orderBy("ord")
    once = hits.withColumn("_b", F.lag("subject").over(w)).where(~F.col("subject").eqNullSafe(F.col("_b")))
    return _kinds(once, least, "group", "ord")


def reciprocal_rows_report(records: DataFrame, least: float = 0.0) -> DataFrame:
    """The same of reports (value) of one group each; a subject's first alignment counts."""
    rows = report_firsts(records)
    return _kinds(rows.withColumnsRenamed({"query": "group", "hit": "ord"}), least, "group", "ord")


def reciprocal_m8(hits: DataFrame, least: float = 0.0) -> DataFrame:
    """group, self_score, query_score, n_others, others (score, taxid) of tabular hits; the query's score defaults to the least, a group without self raises."""
    own, asked = F.max_by("_self", "_self_ord"), F.max_by("_query", "_query_ord")
    missing = F.raise_error(F.concat(F.lit("no self in group "), F.first("group").cast("string"))).cast("double")
    return _by_group(reciprocal_rows_m8(hits, least), F.coalesce(own, missing), F.coalesce(asked, F.min("score")))


def reciprocal_report(records: DataFrame, least: float = 0.0) -> DataFrame:
    """The same of reports, where both scores may be missing."""
    return _by_group(reciprocal_rows_report(records, least), F.max_by("_self", "_self_ord"), F.max_by("_query", "_query_ord"))


def _by_group(rows: DataFrame, own: Column, asked: Column) -> DataFrame:
    rows = rows.withColumns({f"_{k}{x}": F.when(F.col("kind") == k, F.col(c)) for k in ("self", "query") for x, c in (("", "score"), ("_ord", "ord"))})
    other = F.when(F.col("kind") == "other", F.struct("ord", "score", "taxid"))
    listed = F.transform(F.array_sort(F.collect_list(other)), lambda s: F.struct(s["score"].alias("score"), s["taxid"].alias("taxid")))
    return rows.groupBy("group").agg(own.alias("self_score"), asked.alias("query_score"), F.count(other).alias("n_others"), listed.alias("others"))


def blast_index(lines: DataFrame, file: str = "file") -> DataFrame:
    """file, query, offset: where the record of each query of a report begins, in bytes; of a repeated query the first counts.

    Lines (ord, value) end with one byte. Their starts are sums within blocks of lines on top of the blocks' sums.
    """
    rows = lines.select(file, "ord", "value", (F.octet_length("value") + 1).cast("long").alias("_n"), F.floor(F.col("ord") / LINES).alias("_block"))
    before = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(file, "_block").agg(F.sum("_n").alias("_s")).select(file, "_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(file, "_block").orderBy("ord")
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(sums, [file, "_block"])
    rows = rows.withColumn("_at", F.col("_base") + F.col("_in")).withColumn("_head", F.when(F.startswith("value", F.lit("BLAST")), F.col("_at")))
    last = rows.groupBy(file, "_block").agg(F.max("_head").alias("_h")).select(file, "_block", F.max("_h").over(before).alias("_carried"))
    rows = rows.withColumn("_own", F.max("_head").over(own)).join(last, [file, "_block"]).where(F.startswith("value", F.lit("Query=")))
    first = F.min_by(F.coalesce("_own", "_carried", F.lit(-1)), "ord").alias("offset")
    return rows.groupBy(file, F.substring("value", 8, 1 << 30).alias("query")).agg(first)


def hmmscan(lines: DataFrame) -> DataFrame:
    """accession, read, frame, full_evalue, i_evalue, ali_from, ali_to of a domain table; domains that do not rise are left out."""
    f = F.split(F.trim("value"), r"\s+")
    name = F.get(f, F.lit(3))
    frame = F.when(F.endswith(name, F.lit("_blastx")), F.lit(0)).otherwise(F.regexp_extract(name, r"_([+-]?\d+)$", 1).cast("int"))
    rows = lines.where(~F.col("value").startswith("#")).select(
        F.get(f, F.lit(1)).alias("accession"), F.regexp_replace(name, r"_(blastx|[+-]?\d+)$", "").alias("read"), frame.alias("frame"),
        F.get(f, F.lit(6)).cast("double").alias("full_evalue"), F.get(f, F.lit(12)).cast("double").alias("i_evalue"),
        F.get(f, F.lit(17)).cast("int").alias("ali_from"), F.get(f, F.lit(18)).cast("int").alias("ali_to"),
    )
    return rows.where("ali_from < ali_to")


def egt(records: DataFrame) -> DataFrame:
    """pfam, read, evalue, go (array), seq of records (header, seq) with `=+=` between the header's parts; sequences under 10 are left out."""
    f = F.split("header", r"=\+=")
    go = F.regexp_replace(F.get(f, F.lit(3)), r"[{}]", "")
    rows = records.select(F.get(f, F.lit(0)).alias("pfam"), F.get(f, F.lit(1)).alias("read"), F.get(f, F.lit(2)).alias("evalue"), F.filter(F.split(go, ","), lambda x: x != "").alias("go"), "seq")
    return rows.where(F.length("seq") >= 10)


def egt_line(pfam: Column, read: Column, evalue: Column, go: Column) -> Column:
    return F.concat(pfam, F.lit("=+="), read, F.lit("=+="), evalue, F.lit("=+={"), F.array_join(go, ","), F.lit("}"))


def rdp_header(lines: DataFrame) -> DataFrame:
    """id, organism, offset of `>id organism; ...; OFFSETn` lines."""
    off = F.regexp_extract("value", r"OFFSET(\d+)", 1)
    return lines.select(F.regexp_extract("value", r"^>(\S+)", 1).alias("id"), F.regexp_extract("value", r"^>\S+\s+([^;]*)", 1).alias("organism"), F.when(off != "", off.cast("int")).otherwise(0).alias("offset"))


def rna_header(lines: DataFrame) -> DataFrame:
    """id, taxid, offset of `>id_taxid OFFSETn` lines; one without an offset raises."""
    off = F.regexp_extract("value", r"OFFSET(\d+)", 1)
    missing = F.raise_error(F.concat(F.lit("no offset in header: "), "value")).cast("int")
    return lines.select(F.regexp_extract("value", r"^>(\S+)_(\d+)", 1).alias("id"), F.regexp_extract("value", r"^>(\S+)_(\d+)", 2).cast("int").alias("taxid"), F.when(off != "", off.cast("int")).otherwise(missing).alias("offset"))


def obo(records: DataFrame) -> DataFrame:
    """go_id, name, namespace, alt_ids of [Term] stanzas, one a row."""
    get = lambda key: F.regexp_extract("value", rf"(?m)^{key}: (.*)$", 1)
    rows = records.select(get("id").alias("go_id"), get("name").alias("name"), get("namespace").alias("namespace"), F.regexp_extract_all("value", F.lit(r"(?m)^alt_id: (\S+)"), F.lit(1)).alias("alt_ids"))
    return rows.where("go_id <> ''")


def matrix(lines: DataFrame) -> DataFrame:
    """a, b, score of a square matrix: the first line that is not a comment names the columns."""
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("ord", F.split(F.trim("value"), r"\s+").alias("c"))
    head = rows.groupBy().agg(F.min_by("c", "ord").alias("head"), F.min("ord").alias("first"))
    body = rows.join(F.broadcast(head)).where("ord > first")  # one row
    return body.select(F.col("c")[0].alias("a"), F.posexplode(F.slice("c", F.lit(2), F.size("c"))).alias("k", "score"), "head").select("a", F.get("head", F.col("k")).alias("b"), F.col("score").cast("int").alias("score"))


def pfam_taxid(lines: DataFrame, least: int = 10) -> DataFrame:
    """pfam_seq_id, taxid of comma-separated lines; fewer lines than `least` raise, as the file is cut off then."""
    f = F.split("value", ",")
    if lines.limit(least).count() < least:
        raise ValueError(f"fewer than {least} lines of ids and taxa")
    return lines.select(f[0].alias("pfam_seq_id"), f[1].cast("int").alias("taxid"))


def pfam_taxid_table(lines: DataFrame) -> DataFrame:
    """id, taxid of a dump's rows (ord, value): the second and the sixteenth of at least sixteen tab-separated cells in quotes.

    A line that ends in a backslash goes on in the next one. An id with several taxa raises.
    """
    if lines.where(F.endswith("value", F.lit("\\"))).limit(1).count():
        rows = lines.select("ord", "value", F.floor(F.col("ord") / LINES).alias("_block"))
        open_at = rows.groupBy("_block").agg(F.max_by(F.endswith("value", F.lit("\\")), "ord").alias("_open")).select((F.col("_block") + 1).alias("_block"), "_open")
        own = Window.partitionBy("_block").orderBy("ord")
        rows = rows.join(open_at, "_block", "left").withColumn("_goes_on", F.coalesce(F.lag(F.endswith("value", F.lit("\\"))).over(own), "_open", F.lit(False)))
        rows = rows.withColumn("_start", F.max(F.when(~F.col("_goes_on"), F.col("ord"))).over(own))
        last = rows.groupBy("_block").agg(F.max("_start").alias("_l"))
        last = last.select("_block", F.max("_l").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
        rows = rows.join(last, "_block").withColumn("_start", F.coalesce("_start", "_carried"))
        listed = F.array_sort(F.collect_list(F.struct("ord", F.regexp_replace("value", r"\\$", "").alias("v"))))
        lines = rows.groupBy("_start").agg(F.array_join(F.transform(listed, lambda x: x["v"]), "").alias("value"))
    per = quoted(lines, 16).select(F.col("c")[1].alias("id"), F.col("c")[15].cast("int").alias("taxid")).groupBy("id").agg(F.min("taxid").alias("taxid"), F.max("taxid").alias("_high"))
    several = F.raise_error(F.concat(F.lit("several taxa: "), "id")).cast("int")
    return per.select("id", F.when(F.col("taxid").eqNullSafe(F.col("_high")), F.col("taxid")).otherwise(several).alias("taxid"))


def quoted(lines: DataFrame, least: int) -> DataFrame:
    """The cells of tab-separated lines in single quotes that have at least so many."""
    f = F.transform(F.split("value", "\t"), lambda x: F.regexp_replace(x, "^'|'$", ""))
    return lines.select(f.alias("c")).where(F.size("c") >= least)


def pfam_go(families: DataFrame, ontology: DataFrame) -> DataFrame:
    """acc, go: comma-joined terms in file order of families (auto_id, acc) and ontology (auto_id, go_id, ord); a term of an unknown family raises."""
    missing = F.raise_error(F.concat(F.lit("no family of key "), F.col("auto_id").cast("string"))).cast("string")
    rows = ontology.join(families, "auto_id", "left").withColumn("acc", F.coalesce("acc", missing))
    listed = F.array_sort(F.collect_list(F.struct("ord", "go_id")))
    return rows.groupBy("acc").agg(F.array_join(F.transform(listed, lambda s: s["go_id"]), ",").alias("go"))


def blast_fields() -> dict[str, Column]:
    """What is drawn from the lines of a search report, each null where its line is another."""
    v = F.col("value")
    take = lambda pattern, t: F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 1).cast(t))
    return {
        "bitscore": take(r"Score\s*=\s*([0-9.eE+-]+) bits", "double"),
        "evalue": F.when(v.rlike(r"Expect(\(\d+\))?\s*="), F.regexp_replace(F.regexp_extract(v, r"Expect(?:\(\d+\))?\s*=\s*([0-9.eE+-]+)", 1), "^e", "1e").cast("double")),
        "identities": take(r"Identities\s*=\s*(\d+)/", "int"),
        "aln_len": take(r"Identities\s*=\s*\d+/(\d+)", "int"),
        "percent": take(r"Identities\s*=\s*\d+/\d+\s*\((\d+)%\)", "int"),
        "positives": take(r"Positives\s*=\s*(\d+)/", "int"),
        "gaps": F.when(v.rlike(r"Identities\s*="), F.coalesce(F.when(v.rlike(r"Gaps\s*="), F.regexp_extract(v, r"Gaps\s*=\s*(\d+)/", 1).cast("int")), F.lit(0))),
        "frame": take(r"Frame\s*=\s*([+-]?\d)", "int"),
        "seq_start": take(r"^(?:Query|Sbjct):?\s+(\d+)", "int"),
        "seq_end": take(r"^(?:Query|Sbjct):?\s+\d+\s*\D+\s(\d+)\s*$", "int"),
    }


def report_entries(head: str) -> list[str]:
    """The descriptions of a subject, given as its text from `>` to its first score: lines that begin with five spaces go on with the one before."""
    head = head.partition("\n          Length")[0]
    if head[-1:].isspace():
        head = re.sub(r"\n\s*$", "", head)
    entries = [" ".join(e[1:].split()) for e in (re.split(r"\n(?! {5})", head) if "\n" in head else [head])]
    return [e for e in entries if e]


#: Sign of an alignment by its strands; others raise.
STRANDS = {"Plus / Plus": 1, "Plus / Minus": -1}


def report_record(text: str) -> Iterator[dict]:
    """The alignments of one query of a default search report: its subjects in order, each with its alignments.

    A subject's `entries` are its descriptions: lines that begin with five spaces go on with the one before, all
    others up to the length begin a new one. On the minus strand and in negative frames, where numbers fall, a query
    runs from its least number to its greatest.
    """
    found = re.search(r"Query=\s*(\S+)", text)
    query = found[1] if found else None
    kind = re.search(r"^BLAST[A-Z]", text, re.M)
    for place, block in enumerate(re.split(r"\n(?=>)", text)[1:]):
        head, _, rest = block.partition("Score =")
        entries = report_entries(head)
        subject = " ".join(entries)
        for n, hsp in enumerate(re.split(r"(?=Score =)", "Score =" + rest)[1:]):
            num = lambda pattern, kind=int, none=None: (kind(m[1]) if (m := re.search(pattern, hsp)) else none)  # noqa: B023, E731
            q = re.findall(r"^Query:?\s+(\d+)\s+(\S+)\s+(\d+)", hsp, re.M)
            s = re.findall(r"^Sbjct:?\s+(\d+)\s+(\S+)\s+(\d+)", hsp, re.M)
            e = re.search(r"Expect(?:\(\d+\))?\s*=\s*([0-9.eE+-]+)", hsp)
            strand = re.search(r"^ Strand = (.*?)\s*$", hsp, re.M)
            if strand and strand[1] not in STRANDS:
                raise ValueError(f"unknown strands: {strand[1]}")
            frame = STRANDS[strand[1]] if strand else num(r"Frame\s*=\s*([+-]?\d)")
            back, places = (frame or 0) < 0, [int(x) for line in q for x in (line[0], line[2])]
            yield {
                "match": kind[0] if kind else None, "query": query, "hit": place, "subject": subject, "entries": entries, "hsp": n, "bitscore": num(r"Score\s*=\s*([0-9.eE+-]+) bits", float),
                "evalue": float(re.sub("^e", "1e", e[1])) if e else None, "identities": num(r"Identities\s*=\s*(\d+)/"), "aln_len": num(r"Identities\s*=\s*\d+/(\d+)"),
                "percent": num(r"Identities\s*=\s*\d+/\d+\s*\((\d+)%"), "positives": num(r"Positives\s*=\s*(\d+)/"), "gaps": num(r"Gaps\s*=\s*(\d+)/", int, 0), "frame": frame,
                "q_start": (min(places) if back else places[0]) if q else None, "q_end": (max(places) if back else places[-1]) if q else None, "s_start": int(s[0][0]) if s else None, "s_end": int(s[-1][2]) if s else None,
                "q_seq": "".join(x[1] for x in q), "s_seq": "".join(x[1] for x in s),
            }


REPORT = "match string, query string, hit int, subject string, entries array<string>, hsp int, bitscore double, evalue double, identities int, aln_len int, percent int, positives int, gaps int, frame int, q_start int, q_end int, s_start int, s_end int, q_seq string, s_seq string"


def report_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: the records of default search reports, from one banner to the next. Spark cuts the text there, so plain files are read in splits."""
    rows = spark.read.text(path, lineSep="\nBLAST")
    whole = F.when(F.startswith("value", F.lit("BLAST")), F.col("value")).otherwise(F.concat(F.lit("BLAST"), "value"))
    return rows.where(F.contains("value", F.lit("Query="))).select(F.regexp_replace(whole, "\r", "").alias("value"))


def blast_report(records: DataFrame) -> DataFrame:
    """A row for each alignment of records (value: the part of a report from one `Query=` to the next)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in REPORT.split(", ")]
        for frame in frames:
            rows = [r for text in frame["value"] for r in report_record(text)]
            out = pd.DataFrame(rows, columns=columns)
            for c, t in (x.split() for x in REPORT.split(", ")):
                if t == "int":
                    out[c] = out[c].astype("Int32")
            yield out

    return records.select("value").mapInPandas(run, REPORT)


#: An alignment's lines as they are usually laid out; others are looked at one pattern at a time.
_PLAIN = re.compile(r"Score = ([0-9.eE+-]+) bits \([0-9.]+\), Expect(?:\(\d+\))? = ([0-9.eE+-]+)\n Identities = (\d+)/(\d+) \((\d+)%\), Positives = (\d+)/\d+ \(\d+%\)(?:, Gaps = (\d+)/\d+ \(\d+%\))?\n Frame = ([+-]?\d)\n", re.ASCII)
_QUERY, _BITS = re.compile(r"^Query:?\s+(\d+)\s+(\S+)\s+(\d+)", re.M), re.compile(r"Score\s*=\s*([0-9.eE+-]+) bits")
#: What report_subjects takes of a subject's best alignment.
BEST = ["bitscore", "evalue", "aln_len", "percent", "identities", "positives", "gaps", "q_start", "q_end", "q_seq"]
SUBJECTS = pa.schema([("query", pa.string()), ("hit", pa.int32()), ("entries", pa.list_(pa.string())), ("first", pa.float64()), ("top", pa.float64()), *[(c, pa.string() if c == "q_seq" else pa.float64() if c in ("bitscore", "evalue") else pa.int32()) for c in BEST]])


def _plain_alignment(text: str) -> tuple | None:
    """The columns BEST of an alignment that is laid out as usual, else None."""
    m = _PLAIN.match(text)
    if not m or not m[7] and "Gaps" in text or "Strand" in text:
        return None
    q = _QUERY.findall(text, m.end())
    evalue = m[2]
    places = [int(x) for line in q for x in (line[0], line[2])]
    if not q:
        ends = (None, None)
    else:
        ends = (min(places), max(places)) if m[8][0] == "-" and m[8] != "-0" else (places[0], places[-1])
    return float(m[1]), float("1" + evalue if evalue[0] == "e" else evalue), int(m[4]), int(m[5]), int(m[3]), int(m[6]), int(m[7] or 0), *ends, q[0][1] if len(q) == 1 else "".join([x[1] for x in q])


def report_subjects_of(text: str) -> Iterator[tuple]:
    """query, hit, entries, first, top and BEST of each subject of a record; a record without subjects gives its query and nulls."""
    blocks, found = text.split("\n>"), re.search(r"Query=\s*(\S+)", text)
    name = found[1] if found else None
    if len(blocks) == 1:
        yield (name, *[None] * (len(SUBJECTS) - 1))
    for hit, block in enumerate(blocks[1:]):
        head, *parts = block.split("Score =")
        each = [_plain_alignment("Score =" + x) for x in parts]
        if not each or None in each:
            rows = list(report_record("Query= x\n>" + block))
            entries, each = rows[0]["entries"], [tuple(r[c] for c in BEST) for r in rows]
        else:
            entries = report_entries(">" + head)
        best = min(range(len(each)), key=lambda k: (each[k][0] is not None, -(each[k][0] or 0), k))
        yield (name, hit, entries, each[0][0], max([x[0] for x in each if x[0] is not None], default=None), *each[best])


def report_subjects(records: DataFrame) -> DataFrame:
    """A row for each subject of records (value): its descriptions, the bit scores of its first (`first`) and of all alignments (`top`), and its best alignment.

    Of equal bit scores the first is best, an alignment without one before all others. A record without subjects has a
    row of its query alone.
    """
    columns, schema = SUBJECTS.names, SUBJECTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start in range(0, len(texts), 256):
                rows = [r for text in texts[start : start + 256] if text is not None for r in report_subjects_of(text)]
                cells = list(zip(*rows)) or [()] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema.types)], schema=schema)

    kinds = ", ".join(f"{c} {'array<string>' if c == 'entries' else {pa.string(): 'string', pa.float64(): 'double', pa.int32(): 'int'}[t]}" for c, t in zip(schema.names, schema.types))
    return records.select("value").mapInArrow(run, kinds)


def report_firsts(records: DataFrame) -> DataFrame:
    """query, hit, subject (its first word) and bitscore of each subject's first alignment of records (value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, hits, subjects, scores = [], [], [], []
            for text in batch.column(0).to_pylist():
                blocks = text.split("\n>") if text is not None else []
                found = re.search(r"Query=\s*(\S+)", text) if len(blocks) > 1 else None
                for hit, block in enumerate(blocks[1:]):
                    head, *parts = block.split("Score =", 2)
                    if "\n Strand" in block:  # unknown ones raise
                        list(report_record("\n>" + block))
                    score = _BITS.search("Score =" + parts[0]) if parts else None
                    entries = report_entries(">" + head)
                    queries.append(found[1] if found else None)
                    hits.append(hit)
                    subjects.append(entries[0].split(" ", 1)[0] if entries else "")
                    scores.append(float(score[1]) if score else None)
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), pa.array(hits, pa.int32()), pa.array(subjects, pa.string()), pa.array(scores, pa.float64())], names=["query", "hit", "subject", "bitscore"])

    return records.select("value").mapInArrow(run, "query string, hit int, subject string, bitscore double")


def stockholm(lines: DataFrame, file: str = "file") -> DataFrame:
    """file, row_id, aligned: blocks joined in order, upper case, dots as gaps; # lines and what follows // are left out.

    A line may name its row only; a row without any letters is null.
    """
    stop = lines.where("value = '//'").groupBy(file).agg(F.min("ord").alias("_stop"))
    rows = lines.join(stop, file, "left").where((F.col("_stop").isNull() | (F.col("ord") < F.col("_stop"))) & ~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    rows = rows.select(file, F.get(f, F.lit(0)).alias("row_id"), "ord", F.get(f, F.lit(1)).alias("part"))
    listed = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("ord", "part"))))
    joined = F.translate(F.upper(F.array_join(F.transform(listed, lambda s: s["part"]), "")), ".", "-")
    return rows.groupBy(file, "row_id").agg(F.when(F.count("part") > 0, joined).alias("aligned"))


def profile(lines: DataFrame) -> DataFrame:
    """rank, taxon, n of a profile's lines; other lines are left out."""
    parts = lambda k: F.regexp_extract("value", r'^([^\t]+)\t"(.*)"\t(\d+)$', k)
    return lines.select(parts(1).alias("rank"), parts(2).alias("taxon"), parts(3).try_cast("long").alias("n")).where("n is not null")
