"""Functions on DNA, protein and aligned sequences, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The standard genetic code with bases in the order A, T, G, C (first base slowest).
BASES = "ATGC"
CODE = "KNKNIIMIRSRSTTTT*Y*YLFLF*CWCSSSSEDEDVVVVGGGGAAAAQHQHLLLLRRRRPPPP"
# Amino acids with a row of their own in a substitution matrix.
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def codons() -> dict[str, str]:
    return {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def _amino(triplets: Column, other_strand: bool) -> Column:
    """Amino acids of triplets written in digits, by a table with one entry for each number of three digits; X for other letters."""
    table = ["X"] * 334
    for codon, amino in codons().items():
        own = codon[::-1].translate(str.maketrans("ATGC", "TACG")) if other_strand else codon
        table[int(own.translate(str.maketrans(BASES, "0123")))] = amino
    listed = F.array(*[F.lit(x) for x in table])
    return F.transform(triplets, lambda t: F.coalesce(F.get(listed, t.try_cast("int")), F.lit("X")))


def _digits(seq: Column) -> Column:
    """Bases as digits in the order of BASES; what is no base becomes a letter."""
    return F.translate(F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N"), BASES, "0123")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of upper-case bases; U becomes C and lower-case letters become N."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGTU]", "N")), "ACGTU", "TGCAC")


def _triplets(digits: Column, offset: int) -> Column:
    return F.regexp_extract_all(F.substring(digits, offset, 1 << 30), F.lit("..."), F.lit(0))


def translate_frame(seq: Column, frame: int) -> Column:
    """Protein of one reading frame: 1 to 3 forward from that base, -1 to -3 on the other strand by forward codon places modulo 3."""
    amino = _amino(_triplets(_digits(seq), abs(frame)), frame < 0)
    return F.array_join(amino if frame > 0 else F.reverse(amino), "")


def with_frames(rows: DataFrame, seq: str) -> DataFrame:
    """Adds f1, f2, f3, r1, r2, r3, the proteins of all six frames: bases are read once, and f and r of a place share its triplets."""
    rows = rows.withColumn("_digits", _digits(F.col(seq)))
    rows = rows.withColumns({f"_t{k}": _triplets(F.col("_digits"), k) for k in (1, 2, 3)})
    protein = lambda k, other: F.array_join(F.reverse(_amino(F.col(f"_t{k}"), True)) if other else _amino(F.col(f"_t{k}"), False), "")
    return rows.withColumns({f"{'r' if other else 'f'}{k}": protein(k, other) for other in (False, True) for k in (1, 2, 3)}).drop("_digits", "_t1", "_t2", "_t3")


def mask_outer_gaps(seq: Column) -> Column:
    """Gaps before the first and after the last residue become question marks."""
    head, tail = F.length(F.regexp_extract(seq, "^-*", 0)), F.length(F.regexp_extract(seq, "-*$", 0))
    n = F.length(seq)
    inner = F.substring(seq, head + 1, n - head - tail)
    return F.when(head == n, F.repeat(F.lit("?"), n)).otherwise(F.concat(F.repeat(F.lit("?"), head), inner, F.repeat(F.lit("?"), tail)))


def trim_alignment(seq: Column) -> tuple[Column, Column]:
    """The sequence without outer gaps, and how many columns were cut off in front."""
    head, tail = F.length(F.regexp_extract(seq, "^-*", 0)), F.length(F.regexp_extract(seq, "-*$", 0))
    return F.substring(seq, head + 1, F.greatest(F.lit(0), F.length(seq) - head - tail)), head


def substring_region(seq: Column, start: Column, end: Column) -> Column:
    """Bases start to end (from 1); on the other strand where start is after end."""
    return F.when(start > end, reverse_complement(F.substring(seq, end, start - end + 1))).otherwise(F.substring(seq, start, end - start + 1))


def _columns(a: Column, b: Column, start: Column, end: Column) -> Column:
    """Pairs of characters of two rows of an alignment, from start to end (from 0, both included)."""
    n = F.least(F.length(a), F.length(b), end + 1) - start
    cut = lambda x: F.split(F.substring(x, start + 1, F.greatest(n, F.lit(0))), "")
    return F.when(n > 0, F.arrays_zip(cut(a).alias("a"), cut(b).alias("b"))).otherwise(F.array().cast("array<struct<a: string, b: string>>"))


def matrix_table(scores: dict[str, int]) -> Column:
    """Scores by pairs of letters ('AB', '*' for other characters) as an array over places in AMINO, 0 for the other characters."""
    at = {c: k for k, c in enumerate("*" + AMINO)}
    table = [0] * len(at) ** 2
    for (x, y), score in scores.items():
        if x in at and y in at:
            table[len(at) * at[x] + at[y]] = score
    return F.array(*[F.lit(x) for x in table])


def read_matrix(rows: DataFrame) -> dict[str, int]:
    """Scores by pairs of letters of a substitution matrix read as rows (a, b, score); as many rows as pairs of letters."""
    return {r["a"] + r["b"]: r["score"] for r in rows.where((F.length("a") == 1) & (F.length("b") == 1)).collect()}


def pair_score(a: Column, b: Column, matrix: Column | dict[str, int]) -> Column:
    """Score of two characters by a matrix 'AB' -> score, a dictionary or a map column: 0 with a question mark or two gaps; other characters count as '*'.

    A dictionary becomes an array, where a score is found by its place; a map is searched.
    """
    x, y = F.instr(F.lit(AMINO), a), F.instr(F.lit(AMINO), b)
    if isinstance(matrix, dict):
        key = F.when(x == 0, y * (len(AMINO) + 1)).otherwise(x * (len(AMINO) + 1) + y)
        found = F.get(matrix_table(matrix), key)
    else:
        pair = F.when(x == 0, F.concat(b, F.lit("*"))).when(y == 0, F.concat(a, F.lit("*"))).otherwise(F.concat(a, b))
        found = F.coalesce(F.try_element_at(matrix, pair), F.lit(0))
    return F.when((a == "?") | (b == "?") | ((x == 0) & (y == 0)), 0).otherwise(found)


def matrix_score(a: Column, b: Column, start: Column, end: Column, matrix: Column | dict[str, int], least: int = 25) -> Column:
    """Sum of scores over the columns; 0 if fewer than `least` columns are compared."""
    cols = _columns(a, b, start, end)
    total = F.aggregate(cols, F.lit(0), lambda s, p: s + pair_score(p["a"], p["b"], matrix))
    return F.when(F.size(cols) < least, 0).otherwise(total)


def alignment_stats(a: Column, b: Column, start: Column, end: Column, matrix: Column | dict[str, int]) -> Column:
    """struct(length, positives, identities, gaps, percent) over the columns that are not gaps in both."""
    cols = F.filter(_columns(a, b, start, end), lambda p: ~((p["a"] == "-") & (p["b"] == "-")))
    count = lambda f: F.size(F.filter(cols, f))
    identities, length = count(lambda p: p["a"] == p["b"]), F.size(cols)
    return F.struct(
        length.alias("length"), count(lambda p: pair_score(p["a"], p["b"], matrix) > 0).alias("positives"), identities.alias("identities"),
        count(lambda p: (p["a"] == "-") | (p["b"] == "-")).alias("gaps"), F.try_divide(identities * 100, length).cast("int").alias("percent"),
    )


def dna_score(a: Column, b: Column, start: Column, end: Column, match: int = 1, mismatch: int = -3, gap_open: int = -1, gap_more: int = -1) -> Column:
    """Score of two aligned DNA rows; a gap that changes sides is a new one, two n are a mismatch, question marks are skipped."""
    low = lambda c: F.translate(F.lower(c), "u", "t")
    cols = _columns(low(a), low(b), start, end)

    def step(s: Column, p: Column) -> Column:
        x, y = p["a"], p["b"]
        skip = (x == "?") | (y == "?") | ((x == "-") & (y == "-"))
        side = F.when(x == "-", 1).otherwise(2)
        gap = (x == "-") | (y == "-")
        same = F.when((x == y) & (x != "n"), match).otherwise(mismatch)
        more = F.when(gap, F.when(s["side"] == side, gap_more).otherwise(gap_open)).otherwise(same)
        return F.struct(F.when(skip, s["sum"]).otherwise(s["sum"] + more).alias("sum"), F.when(skip, s["side"]).when(gap, side).otherwise(0).alias("side"))

    return F.aggregate(cols, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("side")), step)["sum"]


def m8_score(identity: Column, length: Column, mismatches: Column, openings: Column, match: int = 1, mismatch: int = -3, gap_open: int = -1, gap_more: int = -1) -> Column:
    """Score of a tabular hit from its counts: matches are the whole part of identity times length."""
    matches = F.floor(identity * length / 100).cast("int")
    gaps = length - (matches + mismatches)
    return matches * match + mismatches * mismatch + openings * gap_open + gaps * gap_more


def overlap_fraction(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two intervals over the length of the first."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1) / (a_end - a_start + 1)


def frameshifts(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "/\\", ""))
