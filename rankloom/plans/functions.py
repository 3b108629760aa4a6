"""Queries of functions on sequences and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import formats
from rankloom.functions import sequence as Q
from rankloom.operators import sequences as Z
from rankloom.plans.registry import query
from rankloom.sources import tables as S

# Sequences from texts: all their letters, mapped onto bases.
DNA = "dna AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS s FROM documents)"
CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in Q.codons().items()) + "}"


def dna(spark, sf):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return S.table(spark, sf, "documents").select("doc_id", F.translate(letters, "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC").alias("s"))


def _frame_sql(frame: int) -> str:
    triplets = f"regexp_extract_all(substring(s, {abs(frame)}), '...')"
    if frame > 0:
        return f"array_to_string([coalesce({CODONS}[t], 'X') FOR t IN {triplets}], '')"
    return f"array_to_string(list_reverse([coalesce({CODONS}[translate(reverse(t), 'ACGT', 'TGCA')], 'X') FOR t IN {triplets}]), '')"


@query("translate_frames", f"WITH {DNA} SELECT doc_id, " + ", ".join(f"{_frame_sql(f)} AS {'f' if f > 0 else 'r'}{abs(f)}" for f in (1, 2, 3, -1, -2, -3)) + " FROM dna")
def translate_frames(spark, sf):
    return Q.with_frames(dna(spark, sf), "s").drop("s")


@query("reverse_complement", f"WITH {DNA} SELECT doc_id, translate(reverse(s), 'ACGTU', 'TGCAC') AS rc FROM dna")
def reverse_complement(spark, sf):
    return dna(spark, sf).select("doc_id", Q.reverse_complement(F.col("s")).alias("rc"))


@query("substring_region", f"WITH {DNA} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substring(s, 3, 10) ELSE translate(reverse(substring(s, 5, 8)), 'ACGT', 'TGCA') END AS region FROM dna")
def substring_region(spark, sf):
    even = F.col("doc_id") % 2 == 0
    return dna(spark, sf).select("doc_id", Q.substring_region(F.col("s"), F.when(even, 3).otherwise(12), F.when(even, 12).otherwise(5)).alias("region"))


@query("region_store", f"""WITH {DNA}, want AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 300 AS id, 1 + l_partkey * 7 % 3000 AS a, 1 + l_partkey * 7 % 3000 + l_quantity::INT * 40 AS b, l_suppkey % 2 = 1 AS back FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(CASE WHEN back THEN translate(reverse(substring(s, greatest(1, a - 5), b - greatest(1, a - 5) + 6)), 'ACGT', 'TGCA') ELSE substring(s, greatest(1, a - 5), b - greatest(1, a - 5) + 6) END, '') AS region FROM want LEFT JOIN dna ON id = doc_id""")
def region_store(spark, sf):
    """A region of a stored sequence for each line item, with five letters more on both sides."""
    a = 1 + F.col("l_partkey") * 7 % 3000
    b = a + F.col("l_quantity").cast("int") * 40
    back = F.col("l_suppkey") % 2 == 1
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    wanted = S.table(spark, sf, "lineitem").select(*keys, (F.col("l_orderkey") % 300).alias("id"), F.when(back, b).otherwise(a).alias("start"), F.when(back, a).otherwise(b).alias("end"))
    store = Z.stored(dna(spark, sf).select(F.col("doc_id").alias("id"), F.col("s").alias("seq")), 256)
    return Z.regions(store, wanted, 5, 256).select(*keys, "region")


# Aligned rows: two outer runs of gaps, and gaps inside, by doc_id.
ROWS = DNA + ", al AS (SELECT doc_id, repeat('-', (doc_id % 5)::INT) || replace(s, 'AC', '--') || repeat('-', (doc_id % 3)::INT) AS a, repeat('-', (doc_id % 4)::INT) || replace(s, 'GT', '-N') AS b FROM dna)"


def aligned(spark, sf):
    d = F.col("doc_id")
    gaps = lambda m: F.repeat(F.lit("-"), (d % m).cast("int"))
    return dna(spark, sf).select("doc_id", F.concat(gaps(5), F.replace("s", F.lit("AC"), F.lit("--")), gaps(3)).alias("a"), F.concat(gaps(4), F.replace("s", F.lit("GT"), F.lit("-N"))).alias("b"))


@query("mask_outer_gaps", f"WITH {ROWS} SELECT doc_id, CASE WHEN length(ltrim(a, '-')) = 0 THEN repeat('?', length(a)) ELSE repeat('?', length(a) - length(ltrim(a, '-'))) || trim(a, '-') || repeat('?', length(a) - length(rtrim(a, '-'))) END AS m FROM al")
def mask_outer_gaps(spark, sf):
    return aligned(spark, sf).select("doc_id", Q.mask_outer_gaps(F.col("a")).alias("m"))


@query("trim_alignment", f"WITH {ROWS} SELECT doc_id, trim(a, '-') AS seq, length(a) - length(ltrim(a, '-')) AS off FROM al")
def trim_alignment(spark, sf):
    seq, off = Q.trim_alignment(F.col("a"))
    return aligned(spark, sf).select("doc_id", seq.alias("seq"), off.cast("long").alias("off"))


@query("dot_to_gap", f"WITH {ROWS} SELECT doc_id, lower(replace(replace(a, 'T', '.'), '.', '-')) AS g FROM al")
def dot_to_gap(spark, sf):
    return aligned(spark, sf).select("doc_id", F.lower(F.translate(F.translate("a", "T", "."), ".", "-")).alias("g"))


# A small matrix by rule: 4 on the diagonal, -1 off it, -4 with a gap.
X, Y = "t[1]", "t[2]"
# Columns from the third on, as pairs of characters.
COLUMNS = "z AS (SELECT doc_id, CASE WHEN least(length(a), length(b)) < 3 THEN [] ELSE list_zip(string_split(substring(a, 3), ''), string_split(substring(b, 3), ''), true) END AS z FROM al)"
ACID = "'ACDEFGHIKLMNPQRSTVWY'"
SCORE = f"CASE WHEN {X} = '?' OR {Y} = '?' THEN 0 WHEN NOT contains({ACID}, {X}) AND NOT contains({ACID}, {Y}) THEN 0 WHEN NOT contains({ACID}, {X}) OR NOT contains({ACID}, {Y}) THEN -4 WHEN {X} = {Y} THEN 4 ELSE -1 END"


def rule_matrix():
    return {a + b: 4 if a == b else -1 for a in Q.AMINO for b in Q.AMINO} | {a + "*": -4 for a in Q.AMINO}


@query("blosum_score", f"WITH {ROWS}, {COLUMNS} SELECT doc_id, CASE WHEN len(z) < 25 THEN 0 ELSE list_sum([{SCORE} FOR t IN z]) END::INT AS score FROM z")
def blosum_score(spark, sf):
    return aligned(spark, sf).select("doc_id", Q.matrix_score(F.col("a"), F.col("b"), F.lit(2), F.lit(1 << 30), rule_matrix()).alias("score"))


@query("alignment_stats", f"""WITH {ROWS}, {COLUMNS},
c AS (SELECT doc_id, [t FOR t IN z IF NOT ({X} = '-' AND {Y} = '-')] AS ps FROM z)
SELECT doc_id, len(ps)::INT AS length, len([t FOR t IN ps IF {SCORE} > 0])::INT AS positives, len([t FOR t IN ps IF {X} = {Y}])::INT AS identities, len([t FOR t IN ps IF {X} = '-' OR {Y} = '-'])::INT AS gaps FROM c""")
def alignment_stats(spark, sf):
    stats = Q.alignment_stats(F.col("a"), F.col("b"), F.lit(2), F.lit(1 << 30), rule_matrix())
    return aligned(spark, sf).select("doc_id", stats.alias("s")).select("doc_id", "s.length", "s.positives", "s.identities", "s.gaps")


# With opening and extension alike, the score does not depend on which gap a column extends.
DSCORE = f"CASE WHEN {X} = '-' AND {Y} = '-' THEN 0 WHEN {X} = '-' OR {Y} = '-' THEN -1 WHEN {X} = {Y} AND {X} <> 'N' THEN 1 ELSE -3 END"


@query("dna_affine_score", f"WITH {ROWS}, {COLUMNS} SELECT doc_id, coalesce(list_sum([{DSCORE} FOR t IN z]), 0)::INT AS score FROM z")
def dna_affine_score(spark, sf):
    return aligned(spark, sf).select("doc_id", Q.dna_score(F.col("a"), F.col("b"), F.lit(2), F.lit(1 << 30)).alias("score"))


M8 = "l_quantity::INT * 4 AS len, 60 + l_partkey % 40 AS idy, l_suppkey % 7 AS mm, l_linenumber % 3 AS go"


@query("m8_query_score", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (idy * len // 100 - 3 * mm - go - (len - (idy * len // 100 + mm)))::INT AS score FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {M8} FROM lineitem)")
def m8_query_score(spark, sf):
    score = Q.m8_score(60 + F.col("l_partkey") % 40, F.col("l_quantity").cast("int") * 4, F.col("l_suppkey") % 7, F.col("l_linenumber") % 3)
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.cast("int").alias("score"))


@query("overlap_fraction", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(l_quantity::INT + 20, 40) - greatest(l_quantity::INT, 15) + 1) / 21.0::DOUBLE AS share FROM lineitem")
def overlap_fraction(spark, sf):
    q = F.col("l_quantity").cast("int")
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", Q.overlap_fraction(q, q + 20, F.lit(15), F.lit(40)).alias("share"))


@query("frameshift_count", "SELECT doc_id, length(text) - length(replace(replace(text, '/', ''), '\\', '')) AS n FROM documents")
def frameshift_count(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", Q.frameshifts(F.col("text")).cast("long").alias("n"))


@query("min_sequence_length", f"WITH {DNA} SELECT doc_id FROM dna WHERE length(s) >= 10")
def min_sequence_length(spark, sf):
    return dna(spark, sf).where(F.length("s") >= 10).select("doc_id")


@query("split_columns", "SELECT o_orderkey, list_filter(string_split_regex(o_orderpriority, '[ -]+'), lambda x: x <> '')[1] AS first, len(list_filter(string_split_regex(o_orderpriority, '[ -]+'), lambda x: x <> ''))::BIGINT AS n FROM orders")
def split_columns(spark, sf):
    parts = formats.columns(F.col("o_orderpriority"), " -")
    return S.table(spark, sf, "orders").select("o_orderkey", F.get(parts, F.lit(0)).alias("first"), F.size(parts).cast("long").alias("n"))


@query("subject_id", "SELECT c_custkey, replace(string_split('gi|' || c_custkey || '|' || c_name || ' strain x', ' ')[1], '|', '\\|') AS id FROM customer")
def subject_id(spark, sf):
    line = F.concat(F.lit("gi|"), F.col("c_custkey").cast("string"), F.lit("|"), F.col("c_name"), F.lit(" strain x"))
    return S.table(spark, sf, "customer").select("c_custkey", F.replace(F.regexp_extract(line, "^[^ ]*", 0), F.lit("|"), F.lit("\\|")).alias("id"))


@query("id_taxid_suffix", "SELECT c_name AS id, 1000000 + c_custkey AS taxid FROM customer")
def id_taxid_suffix(spark, sf):
    """Splits `id_taxid` at its last underscore."""
    joined = F.concat("c_name", F.lit("_"), (1000000 + F.col("c_custkey")).cast("string"))
    rows = S.table(spark, sf, "customer").select(joined.alias("x"))
    return rows.select(F.regexp_extract("x", "^(.*)_([0-9]+)$", 1).alias("id"), F.regexp_extract("x", "^(.*)_([0-9]+)$", 2).cast("long").alias("taxid"))


@query("split_chunks", "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id)::INT AS chunk FROM documents")
def split_chunks(spark, sf):
    """Balanced contiguous chunks, the first ones with one more: from a place in order, counted by range partitions."""
    from rankloom.operators.chunks import chunked

    return chunked(S.table(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@query("split_by_family", "SELECT p_brand AS family, count(*) AS n FROM part GROUP BY 1")
def split_by_family(spark, sf):
    return S.table(spark, sf, "part").groupBy(F.col("p_brand").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("gap_columns", f"""WITH {ROWS}, e AS (SELECT unnest(string_split(a, '')) AS c, generate_subscripts(string_split(a, ''), 1) AS p FROM al WHERE a <> ''),
g AS (SELECT p FROM e GROUP BY p HAVING bool_and(c = '-')) SELECT p::INT AS pos FROM g""")
def gap_columns(spark, sf):
    """Columns that are a gap in every row: one bit a column and row, folded before the shuffle."""
    rows = aligned(spark, sf).select(F.posexplode(F.split("a", "")).alias("pos", "c"))
    return rows.groupBy((F.col("pos") + 1).alias("pos")).agg(F.bool_and(F.col("c") == "-").alias("gap")).where("gap").select("pos")
