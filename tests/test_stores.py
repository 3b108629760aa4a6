"""Sequence blocks, files of families and profiles, and inputs that must raise."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import formats, sequence
from rankloom.operators import joins, organisms, profile, sequences, taxonomy
from rankloom.sources import parsers, sinks


def test_regions_equal_substrings(spark):
    rng = random.Random(5)
    texts = {f"s{k}": "".join(rng.choices("ACGT", k=n)) for k, n in enumerate((0, 1, 7, 8, 9, 100))}
    records = spark.createDataFrame(list(texts.items()) + [("none", None)], "id string, seq string")
    wanted = [(k, rng.choice([*texts, "lost"]), rng.randint(1, 110), rng.randint(1, 110)) for k in range(300)]
    wanted += wanted[:3]
    table = spark.createDataFrame(wanted, "k int, id string, start int, end int")
    for margin in (0, 5):
        got = sorted((r["k"], r["region"]) for r in sequences.regions(sequences.stored(records, 8), table, margin, 8).collect())
        want = []
        for k, name, a, b in wanted:
            cut = texts.get(name, "")[max(1, min(a, b) - margin) - 1 : max(a, b) + margin]
            want.append((k, (cut[::-1].translate(str.maketrans("ACGT", "TGCA")) if a > b else cut) or None))
        assert got == sorted(want)
    with pytest.raises(Exception, match="start after end"):
        sequences.regions(sequences.stored(records, 8), table.where("start > end and id = 's5' and start < 90"), 0, 8, strands=False).collect()


def test_family_files(spark, tmp_path):
    """A family of half the rows is cut into parts; each folder gives back its records."""
    rows = [("hot" if k % 2 else f"f{k % 5}", f"r{k}", "MK" * (k % 4 + 1)) for k in range(400)]
    path = f"file://{tmp_path}/families"
    sinks.write_families(spark.createDataFrame(rows, "family string, header string, seq string"), path, per_file=40)
    back = []
    for folder in (tmp_path / "families").glob("family=*"):
        files = [f for f in folder.glob("*.txt")]
        assert folder.name != "family=hot" or len(files) >= 5
        found = parsers.fasta_files(spark, [f"file://{f}" for f in files]).collect()
        back += [(folder.name.removeprefix("family="), r["id"], r["seq"]) for r in found]
    assert sorted(back) == sorted(rows)


def test_profile_files(spark, tmp_path):
    rows = [("genus", 'a "b"', 3), ("phylum", "x", 9), ("genus", "c", 5)]
    path = f"file://{tmp_path}/profile"
    sinks.profile_lines(spark.createDataFrame(rows, "rank string, taxon string, n long")).coalesce(1).write.text(path)
    text = spark.read.text(path)
    assert [r["value"] for r in text.collect()] == ['phylum\t"x"\t9', 'genus\t"c"\t5', 'genus\t"a "b""\t3']
    assert sorted(tuple(r) for r in parsers.profile(text).collect()) == sorted(rows)


def test_comparative_lines(spark):
    rows = spark.createDataFrame([("s1", "genus", "a", 3), ("s1", "genus", "b", 1), ("s2", "genus", "a", 1), ("s2", "genus", "rare", 999), ("s3", "genus", "d", 4)], "sample string, rank string, taxon string, n long")
    wide = profile.comparative_wide(rows, ["s1", "s2"], 0.01)
    assert [r["line"] for r in sinks.comparative_lines(wide, ["s1", "s2"]).collect()] == ['genus\t"a"\t0.7500\t0.0010', 'genus\t"b"\t0.2500\t0', 'genus\t"rare"\t0\t0.9990']
    away = profile.filtered_away(rows, ["s1", "s2", "s3"], 0.8)
    row = sinks.filtered_lines(away, ["s1", "s2", "s3"]).first()
    assert (row["count_line"], row["share_line"]) == ("genus\t4\t1\t0", "genus\t--\t0.0010\t0.0000")
    terms = spark.createDataFrame([("g1", "t one", "p", 2), ("g2", "t two", "f", 5)], "go_id string, term string, category string, n long")
    assert [r["line"] for r in sinks.functional_lines(terms).collect()] == ['g2\t"t two"\t5', 'g1\t"t one"\t2']
    assert sinks.functional_lines(terms, "p").count() == 1


def test_faults_raise(spark):
    two = spark.createDataFrame([(1, "a", "0.5"), (1, "a", "0.1"), (2, "a", "-"), (2, "b", "-"), (3, "b", "7")], "priority int, read string, evalue string")
    assert [r["read"] for r in profile.best_evalue_wins(two.where("evalue <> '0.1'"), file="priority").orderBy("read").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="twice in one file: a"):
        profile.best_evalue_wins(two, file="priority").collect()
    with pytest.raises(Exception, match="repeated: a"):
        joins.only_once(two, "read").collect()
    assert [tuple(r) for r in joins.repeated(two, "priority", "read").collect()] == [(1, "a", 2)]
    with pytest.raises(ValueError, match="fewer than 10"):
        parsers.pfam_taxid(spark.createDataFrame([("a,1",)] * 9, "value string"))
    families, terms = spark.createDataFrame([(1, "PF1")], "auto_id int, acc string"), spark.createDataFrame([(1, "GO:1", 0), (2, "GO:2", 1)], "auto_id int, go_id string, ord int")
    with pytest.raises(Exception, match="no family of key 2"):
        parsers.pfam_go(families, terms).collect()
    with pytest.raises(Exception, match="no offset"):
        parsers.rna_header(spark.createDataFrame([(">S_1",)], "value string")).collect()


def test_columns(spark):
    rows = spark.createDataFrame([("a, b,,c", "x->y->z")], "s string, t string")
    row = rows.select(formats.columns(F.col("s"), ", ").alias("s"), formats.columns(F.col("t"), separator="->").alias("t")).first()
    assert (row["s"], row["t"]) == (["a", "b", "c"], ["x", "y", "z"])
    for bad, how in (("a,b,", {"separators": ","}), ("x->", {"separator": "->"})):
        with pytest.raises(Exception, match="nothing after"):
            spark.createDataFrame([(bad,)], "s string").select(formats.columns(F.col("s"), **how)).collect()


def test_deep_and_cyclic_taxonomies(spark):
    chain = [(k, max(1, k - 1), 0) for k in range(1, 601)]
    found = taxonomy.lineages(spark.createDataFrame(chain, "taxid int, parent int, rank int"))
    assert found.count() == 600 and found.where("taxid = 600").select(F.size("path")).first()[0] == 600
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.lineages(spark.createDataFrame([(1, 1, 0), (2, 3, 0), (3, 2, 0), (4, 3, 0)], "taxid int, parent int, rank int"))


def test_specific_records(spark):
    """Outer gaps of the row without all-gap columns are its offset; OFFSET0 is written; a repeated id raises."""
    nodes = [(1, 1, 0), (131567, 1, 0), (2, 131567, 1), (10, 2, 5), (11, 10, 23), (12, 11, 27), (13, 11, 27)]
    tree = taxonomy.lineages(spark.createDataFrame(nodes, "taxid int, parent int, rank int"))
    names = spark.createDataFrame([(11, "genus")], "taxid int, name string")
    rows = spark.createDataFrame([("A", 12, "--AC-GT--"), ("B", 13, "-TAC-G---")], "id string, taxid int, aligned string")
    got = {r["record"] for r in organisms.specific_records(rows, tree, names, [], 19).collect()}
    assert got == {">A_12 OFFSET1\nACGT", ">B_13 OFFSET0\nTACG"}
    with pytest.raises(Exception, match="repeated id: A"):
        organisms.specific_records(rows.unionByName(rows.where("id = 'A'")), tree, names, [], 19).collect()
    again = parsers.rna_header(spark.createDataFrame([(x.split("\n")[0],) for x in got], "value string"))
    assert sorted(tuple(r) for r in again.collect()) == [("A", 12, 1), ("B", 13, 0)]


def test_groups_by_runs(spark, monkeypatch):
    """A query that comes back begins a new group, a comment without hits an empty one, over blocks of lines."""
    monkeypatch.setattr(parsers, "LINES", 3)
    hit = lambda q: "\t".join([q, *["1"] * 11])
    texts = ["# Query: a", hit("a"), hit("a"), "# Query: e", "# Fields: x", "# Query: b", hit("b"), hit("a"), hit("a"), hit("a"), hit("a"), hit("a"), "", hit("b"), "# Query: b", hit("b")]
    rows = parsers.m8_groups(spark.createDataFrame(list(enumerate(texts)), "ord long, value string"))
    got = sorted((r["group"], r["query"], r["n"]) for r in rows.groupBy("group", "query").agg(F.count("bitscore").alias("n")).collect())
    assert got == [(0, "a", 2), (3, "e", 0), (5, "b", 1), (7, "a", 5), (13, "b", 1), (14, "b", 1)]


def test_translation_is_unchanged(spark):
    assert spark.range(1).select(sequence.translate_frame(F.lit("ATGGCC"), 1)).first()[0] == "MA"


def test_lca_by_number_is_that_of_lineages(spark):
    rng = random.Random(11)
    nodes = [(1, 1, 0), (131567, 1, 0), (12908, 1, 0)] + [(k, rng.choice([1, 131567, 12908, *range(2, k)] if k > 2 else [131567]), 0) for k in range(2, 300)]
    tree = taxonomy.lineages(spark.createDataFrame(nodes, "taxid int, parent int, rank int"))
    hits = spark.createDataFrame([(rng.randint(0, 150), rng.choice([0, 999, *range(1, 300)] if k % 9 else [12908])) for k in range(900)], "query int, taxid int")
    numbered = taxonomy.numbered(tree)
    by = {r["taxid"]: r for r in numbered.collect()}
    assert sorted(r["enter"] for r in by.values()) == list(range(1, len(by) + 1)) and by[1]["exit"] == len(by)
    for r in by.values():
        assert [by[s["taxid"]]["exit"] for s in r["path"]] == r["exits"] and all(by[s["taxid"]]["enter"] <= r["enter"] <= by[s["taxid"]]["exit"] for s in r["path"])
    want = sorted(tuple(r) for r in taxonomy.lca_of_hits(taxonomy.with_path(hits, tree)).collect())
    assert sorted(tuple(r) for r in taxonomy.lca_by_number(hits, numbered).collect()) == want


def test_broken_lines_and_conflicts(spark, monkeypatch):
    """A dump's row over many lines, across blocks of lines; an id with two taxa raises."""
    monkeypatch.setattr(parsers, "LINES", 3)
    cells = ["'0'", "'id{}'", *["''"] * 13, "'{}'"]
    whole = lambda k, t: "\t".join(cells).format(k, t)
    broken = [*(c + "\t\\" for c in whole(2, 7).split("\t")[:-1]), "'7'"]
    lines = [whole(1, 5), *broken, whole(3, 9), whole(1, 5), "'short'\t'x'"]
    table = lambda rows: spark.createDataFrame(list(enumerate(rows)), "ord long, value string")
    assert sorted(tuple(r) for r in parsers.pfam_taxid_table(table(lines)).collect()) == [("id1", 5), ("id2", 7), ("id3", 9)]
    with pytest.raises(Exception, match="several taxa: id1"):
        parsers.pfam_taxid_table(table([*lines, whole(1, 6)])).collect()


def test_ranks_of_a_lineage(spark):
    rows = spark.createDataFrame([(1, [(1, 0), (2, 1), (5, 5), (6, 5), (9, 27)]), (2, [(1, 0)])], "k int, path array<struct<taxid:int,rank:int>>")
    assert [r["by_rank"] for r in taxonomy.ranks_of(rows).orderBy("k").collect()] == [{"superkingdom": 2, "phylum": 6, "species": 9}, {}]
