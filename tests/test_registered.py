"""Functions in SQL text, bins, alignments in waves and number formats against plain Python."""

import random

from pyspark.sql import functions as F

from rankloom.functions import formats, ranks, registered, sequence
from rankloom.operators import joins
from tests.test_reads import REPORT


def test_sql_functions(spark):
    registered.register(spark)
    row = spark.sql("SELECT taxon_lca(array(1, 2, 3), array(1, 2, 4)) AS a, common_path_length(array(1, 2), array(1, 2, 4)) AS b, simple_rank(19) AS c, rank_name(27) AS d, reverse_complement('ACGUx') AS e, dna_region('ACGTAC', 4, 2) AS f, overlap_fraction(1, 10, 6, 20) AS g, read_of('r_1_+1_-2') AS h").first()
    assert tuple(row) == (2, 2, 2, "species", "NCCGT", "ACG", 0.5, "r_1")
    spark.range(1).select(F.lit(REPORT).alias("value")).createOrReplaceTempView("reports")
    got = spark.sql("SELECT query, subject, frame FROM reports, LATERAL search_report(value) ORDER BY hit, hsp").collect()
    assert len(got) == 5 and got[0]["query"] == "r1" and [r["frame"] for r in got] == [-1, 1, None, -1, None]
    both = spark.range(40).select(F.col("id").cast("int").alias("r"))
    both.createOrReplaceTempView("ranks_")
    assert both.select(ranks.simple_rank(F.col("r"))).collect() == spark.sql("SELECT simple_rank(r) FROM ranks_").collect()
    assert spark.range(1).select(sequence.reverse_complement(F.lit("ACGUx"))).first()[0] == row["e"]


def test_bins_are_those_of_the_sequential_rule(spark):
    rng = random.Random(4)
    for bins, families in ((1, 5), (3, 40), (8, 500), (8, 3)):
        rows = [(f"f{k:03d}", rng.choice([1, 1, 1, 2, 5, 5, 40, rng.randint(1, 60)])) for k in range(families)]
        load, want = [0] * bins, {}
        for name, n in sorted(rows, key=lambda r: (-r[1], r[0])):
            at = load.index(min(load))
            want[name] = at
            load[at] += n
        got = {r["family"]: r["bin"] for r in joins.greedy_bins(spark.createDataFrame(rows, "family string, n long"), bins).collect()}
        assert got == want


def test_waves_equal_letter_by_letter(spark):
    rng = random.Random(9)
    letters = "ACDX"
    scores = {x + y: rng.randint(-4, 6) for x in "ACD" for y in "ACD"}

    def one(a, b, band):
        low = -(1 << 30)
        cell = {(0, 0): 0}
        for i in range(len(a) + 1):
            for j in range(max(0, i - band), min(len(b), i + band) + 1):
                if i or j:
                    diagonal = cell.get((i - 1, j - 1), low) + (scores.get(a[i - 1] + b[j - 1], 0) if i and j else low)
                    cell[i, j] = max(diagonal, cell.get((i - 1, j), low) - 4, cell.get((i, j - 1), low) - 4)
        return cell[len(a), len(b)]

    text = lambda: "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 20, 60])))
    for band in (1, 4):
        pairs = [(k, a := text(), "".join(c for c in a if rng.random() > 0.05) + rng.choice(["", "A", "日"])) for k in range(80)] + [(80, None, "A"), (81, "A" * 9, "")]
        score = formats.banded_score(scores, band, together=7)
        got = [r["s"] for r in spark.createDataFrame(pairs, "k int, a string, b string").select("k", score("a", "b").alias("s")).orderBy("k").collect()]
        assert got == [one(a, b, band) if a is not None and abs(len(a) - len(b)) <= band else None for _, a, b in pairs]


def test_six_digits_is_exact_on_halves(spark):
    numbers = [0.1234565, 1.234565, 12345.65, 1.000005, 2.5, 100000.5, 123456.5, 1234565.0, 1.234565e-7, 0.00012345650000000001, 0.0, -1.234575, 3.0e10, 1.0e-5, 999999.5]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double")
    got = [r["s"] for r in rows.select("k", formats.six_digits(F.col("x")).alias("s")).orderBy("k").collect()]
    assert got == ["%g" % x for x in numbers]
