"""Modes on search results: files of hits and of the reciprocal search, read and classified."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import reads, taxonomy
from rankloom.sources import parsers, sinks

NODES = [(1, 1, 0), (131567, 1, 0), (2, 131567, 1), (10, 2, 5), (11, 10, 23), (12, 11, 27), (13, 11, 27), (20, 2, 5), (21, 20, 27)]


@pytest.fixture(scope="module")
def tree(spark):
    return taxonomy.lineages(spark.createDataFrame(NODES, "taxid int, parent int, rank int"))


def lines(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "ord long, value string")


def m8(query, subject, score, ev="1e-9", length=90):
    return "\t".join(map(str, (query, subject, 90, length, 1, 0, 1, length, 5, 5 + length, ev, score)))


def test_match_types():
    assert [reads.match_type(*k) for k in (("n", "p"), ("n", "r"), ("p", "p"))] == ["BLASTX", "BLASTN", "BLASTP"]
    for pair in (("p", "n"), ("n", "x"), ("x", "p")):
        with pytest.raises(ValueError):
            reads.match_type(*pair)


def test_table(spark, tree):
    """A query without hits is kept, neighbouring rows of a subject count once, other scores decide the rank."""
    texts = ["# Query: q1 a read", m8("q1", "S1_12", 200), m8("q1", "S1_12", 190), m8("q1", "S2_13", 150), m8("q1", "S3_21", 90), "# Query: q2", "# Query: q3", m8("q3", "S1_12", 200), "# Query: q4", m8("q4", "S9_12", 20), m8("q4", "S9_13", 50)]
    queries, hits = reads.tabular_hits(lines(spark, *texts))
    assert sorted(r["query"] for r in queries.collect()) == ["q1", "q2", "q3", "q4"]
    assert hits.count() == 6
    back = lines(spark, m8("q1", "self", 300), m8("q1", "query", 240), m8("q1", "13", 220), m8("q1", "21", 100), m8("q3", "self", 1))
    found = parsers.reciprocal_rows_m8(parsers.blast_m8(back).withColumnRenamed("query", "group")).withColumnRenamed("group", "query")
    got = {r["query"]: tuple(r)[1:4] for r in reads.classify_blast(queries, hits, found, tree, "n", "r").collect()}
    # 240 beats the best of the genus (220): slot 1 is set, so the species is not reached and the genus is kept.
    assert got["q1"] == ("interval_BLASTN", 11, 1e-9)
    assert got["q2"] == ("no_hits", 0, None) and got["q3"] == ("single_hit", 12, 1e-9) and got["q4"] == ("no_hits2", 0, None)


def test_table_faults(spark, tree):
    queries, hits = reads.tabular_hits(lines(spark, m8("q", "S1_12", 200), m8("q", "S2_13", 150)))
    back = lines(spark, m8("q", "query", 240), m8("q", "13", 220))
    found = parsers.reciprocal_rows_m8(parsers.blast_m8(back).withColumnRenamed("query", "group")).withColumnRenamed("group", "query")
    with pytest.raises(Exception, match="no self"):
        reads.classify_blast(queries, hits, found, tree, "n", "n").collect()
    with pytest.raises(Exception, match="no self"):
        parsers.reciprocal_m8(parsers.blast_m8(back).withColumnRenamed("query", "group")).collect()
    with pytest.raises(Exception, match="no taxon in subject"):
        reads.tabular_hits(lines(spark, m8("q", "S1_2_3", 200)))[1].collect()


def test_reciprocal_keeps_other_scores(spark):
    back = lines(spark, m8("g", "self", 300), m8("g", "13", 220), m8("g", "13", 210), m8("g", "21", 100), m8("g", "13", 90), m8("g", "11", 20))
    row = parsers.reciprocal_m8(parsers.blast_m8(back).withColumnRenamed("query", "group"), 50).first()
    assert (row["self_score"], row["query_score"], row["n_others"]) == (300, 20, 3)
    assert [tuple(o) for o in row["others"]] == [(220.0, 13), (100.0, 21), (90.0, 13)]


REPORT = """BLASTX 2.2

Query= r1 text
         (90 letters)

>gi|1|x a thing [no
     such name]
 gi|2|y other [Good
     name]
          Length = 9

 Score = 100 bits (9), Expect = 1e-9
 Identities = 60/80 (75%), Positives = 62/80 (77%)
 Frame = -1

Query: 300 MK 290
           MK
Sbjct: 1 MK 2
Query: 289 VL 1
           VL
Sbjct: 3 VL 4

 Score = 120 bits (9), Expect = 1e-9
 Identities = 60/80 (75%), Positives = 62/80 (77%), Gaps = 1/80 (1%)
 Frame = +1

Query: 1 MK 240
         MK
Sbjct: 1 MK 2

>gi|3|x nobody [knows it]
          Length = 9

 Score = 900 bits (9), Expect = 1e-9

>gi|4|x a thing [second name]
          Length = 9

 Score = 110 bits (9), Expect = 1e-9
 Identities = 70/80 (88%), Positives = 72/80 (90%)
 Strand = Plus / Minus

>gi|5|x a thing [good name]
          Length = 9

 Score = 130 bits (9), Expect = 1e-9
 Identities = 70/80 (88%), Positives = 72/80 (90%)
"""


def test_report_parser(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text(REPORT + REPORT.replace("r1", "r2") + "BLASTX 2.2\n\nQuery= r3\n\n ***** No hits found ******\n")
    records = parsers.report_files(spark, f"file://{path}")
    rows = parsers.blast_report(records).orderBy("query", "hit", "hsp").collect()
    assert len(rows) == 10 and {r["match"] for r in rows} == {"BLASTX"} and records.count() == 3
    assert rows[0]["entries"] == ["gi|1|x a thing [no such name]", "gi|2|y other [Good name]"]
    assert [(r["frame"], r["q_start"], r["q_end"], r["q_seq"]) for r in rows[:2]] == [(-1, 1, 300, "MKVL"), (1, 1, 240, "MK")]
    assert [r["frame"] for r in rows[2:5]] == [None, -1, None]
    names = spark.createDataFrame([("good name", 12), ("second name", 13)], "name string, taxid int")
    queries, hits = reads.report_hits(records, names)
    assert sorted(r["query"] for r in queries.collect()) == ["r1", "r2", "r3"]
    # The second subject names no taxon; the third does not beat 120, the fourth does and goes to the front.
    got = [tuple(r) for r in hits.where("query = 'r1'").select("taxid", "score", "aln_len").orderBy("ord").collect()]
    assert got == [(12, 130.0, 80), (12, 120.0, 80), (13, 110.0, 80)]
    with pytest.raises(Exception, match="unknown strands"):
        parsers.blast_report(records.select(F.regexp_replace("value", "Plus / Minus", "Minus / Minus").alias("value"))).collect()


def test_report_mode_without_worse_hit(spark, tree):
    """The lineage already cut by scores is cut again by the alignment, never lengthened."""
    hits = spark.createDataFrame([("q", k, t, s, 1e-9, 80, 27) for k, (t, s) in enumerate([(12, 100.0), (13, 99.0)])], "query string, ord long, taxid int, score double, ev double, aln_len int, support int")
    found = spark.createDataFrame([("q", "self", None, 300.0, 0), ("q", "query", None, 200.0, 1), ("q", "other", 13, 250.0, 2)], "query string, kind string, taxid int, score double, ord long")
    row = reads.classify_blast(hits.select("query").distinct(), hits, found, tree, "n", "p").first()
    # The only other is of the genus and better (250), so the family is chosen without a worse hit: its lineage ends at the phylum.
    assert (row["property"], row["taxid"]) == ("interval_BLASTX", 10)


def test_translations_of_unsettled_reads(spark):
    """Only reads with hits that the first share leaves open are written, with the letters of the hit that stands first."""
    hits = spark.createDataFrame([("a", 1, "LATE"), ("a", -3, "FRNT"), ("b", 0, "DNE"), ("c", 0, "SML")], "query string, ord long, q_seq string")
    classified = spark.createDataFrame([("a", 1.0), ("b", 0.1), ("c", 0.3), ("d", 1.0)], "query string, share double")
    got = sinks.translation_records(reads.translations(classified, hits))
    assert sorted(r["record"] for r in got.collect()) == ["> a\nFRNT", "> c\nSML"]
