"""Rows that larger or odd tables hold and the given ones lack."""

import random
import shutil

from pyspark.sql import functions as F

from rankloom.functions import formats
from rankloom.operators import modes, reads
from rankloom.plans import registry
from rankloom.sources import parsers, tables
from tests.oracle_check import compare, connect
from tests.test_reads import REPORT

SF = "/root/testdata/sf0.001"


def test_stockholm_rows_without_letters(spark, tmp_path):
    """Empty and missing texts: a row that is named without letters is no error."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "benchmark", "labels", "conversations"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    text = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 != 1, F.col("text"))
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", text).toPandas().to_parquet(tmp_path / "documents.parquet")
    name = "scan_stockholm"
    assert compare(spark, connect(tmp_path), name, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path)) == ""
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(["# STOCKHOLM 1.0", "a", "b ac", "a g.", "", "c", "b", "//", "c t"])], "file string, ord int, value string")
    assert {r["row_id"]: r["aligned"] for r in parsers.stockholm(lines).collect()} == {"a": "G-", "b": "AC", "c": None}


def counted(spark, texts):
    """Records, and a counter of how often one has been made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def value(text):
        made.add(1)
        return text

    return spark.createDataFrame([(t,) for t in texts], "value string").select(value.asNondeterministic()("value").alias("value")), made


def test_reports_are_made_and_read_once(spark):
    """Queries come from the same pass as the hits: making the records is as dear as reading them."""
    records, made = counted(spark, [REPORT.replace("r1", f"r{k}") for k in range(5)] + ["BLASTX 2.2\n\nQuery= none\n\n ***** No hits found ******\n"])
    names = spark.createDataFrame([("good name", 12), ("second name", 13)], "name string, taxid int")
    queries, hits = reads.report_hits(records, names)
    assert (queries.count(), hits.count(), made.value) == (6, 15, 6)


def test_subjects_are_those_of_the_plain_reader():
    """The quick reader of subjects gives what the plain one gives, also where reports are broken."""
    rng, base = random.Random(4), REPORT.replace(" Strand = Plus / Minus\n", "")
    pieces = ["\n", " ", ">", "-", "e", "9", "Score =", "Gaps = 3/", "Frame = -1", "Query: 7 A 9\n", "     ", "Expect=5", "]", "["]

    def plain(text):
        by = {}
        for r in parsers.report_record(text):
            by.setdefault(r["hit"], []).append(r)
        for hit, each in by.items():
            best = min(each, key=lambda r: (r["bitscore"] is not None, -(r["bitscore"] or 0), r["hsp"]))
            yield (each[0]["query"], hit, each[0]["entries"], each[0]["bitscore"], max((r["bitscore"] for r in each if r["bitscore"] is not None), default=None), *[best[c] for c in parsers.BEST])

    for _ in range(2000):
        text = base
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(pieces) + text[at + rng.randint(0, 2) :]
        outcome = []
        for read in (plain, lambda t: (x for x in parsers.report_subjects_of(t) if x[1] is not None)):
            try:
                outcome.append(list(read(text)))
            except ValueError as e:
                outcome.append(str(e)[:20])
        assert outcome[0] == outcome[1], text


def test_hits_of_reports_are_stored(spark):
    """Classification and translations both read the hits: finding their taxa again would cost all shuffles twice."""
    records = spark.createDataFrame([(REPORT,)], "value string")
    names = spark.createDataFrame([("good name", 12), ("second name", 13)], "name string, taxid int")
    _, hits = reads.report_hits(records, names)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    first = reads.translations(spark.createDataFrame([("r1", 1.0)], "query string, share double"), hits)
    assert first.count() == 1


def test_six_digits_are_those_of_c(spark):
    """Halves, carries and far exponents, all without a row leaving the JVM."""
    rng = random.Random(6)
    numbers = [0.0, 1e-5, 9.999995, 99999.95, 999999.5, 0.000099999951, -2.5e-7, 1e300, 123456.5, 123457.5, float("inf"), float("-inf"), float("nan"), 100000.0, 1e6, 1e-4]
    numbers += [(1 - 2 * rng.randint(0, 1)) * (10 * rng.randint(100_000, 999_999) + 5) * 10.0 ** rng.randint(-40, 40) for _ in range(3000)]
    numbers += [rng.randint(100_000, 999_999) + 0.5 for _ in range(300)] + [(1000005 + 10 * k) / 1e7 for k in range(300)] + [rng.random() * 10.0 ** rng.randint(-12, 12) for _ in range(2000)]
    rows = spark.createDataFrame([(x, "%g" % x) for x in numbers], "x double, want string").withColumn("got", formats.six_digits(F.col("x")))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    rows = formats.with_six_digits(rows, {"held": F.col("x")})
    assert [tuple(r) for r in rows.where("not (got <=> want and held <=> want)").collect()] == []


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_shares_do_not_multiply_hits(spark):
    """Hits are shuffled once, not once for each share of the best score."""
    assert "explode([0.1,0.3,0.6,1.0])" not in plan_of(registry.queries()["adaptive_top_percent"](spark, SF))


def test_fragments_meet_subjects_narrowly(spark):
    """Aligned rows do not travel with all hits of a query; residues are found with and without gaps."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = registry.queries()["classify_16s"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning(query") + plan.count("Exchange hashpartitioning(l_orderkey") == 2
    rows = spark.createDataFrame([("??ACG", 1, 2), ("??ACG", 3, 4), ("??ACG", 4, None), ("?A-C?G", 2, 3), ("?A-C?G", 3, 5), ("ACG", 2, 1), ("--", 1, None)], "row string, place int, want int")
    assert rows.withColumn("got", modes._residue(F.col("row"), F.col("place"))).where("not (got <=> want)").count() == 0


def test_line_items_are_shuffled_once(spark):
    """Lines of hits and of the reciprocal search share one shuffle of the line items, by their order."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = tables.hits(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("Exchange hashpartitioning(o_custkey") == 1
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(lines) == 5  # line items, orders with customers, orders, customers, segments
