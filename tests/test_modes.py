"""Modes on aligned rows, organism names, banded alignment and reports against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import formats, sequence
from rankloom.operators import classify, modes, organisms, profile, taxonomy
from rankloom.plans.functions import rule_matrix
from rankloom.sources import parsers
from tests.test_core import NODES, mirror

PATHS = {}
for t, p, r in NODES:
    PATHS[t] = (p, r)


def path(t):
    out = []
    while True:
        out.append(t)
        if t not in PATHS or PATHS[t][0] == t:
            return out[::-1]
        t = PATHS[t][0]


def rank_of(a, b):
    shared = [x for x in path(a) if x in path(b)]
    ranks = [PATHS[x][1] for x in shared if PATHS[x][1]]
    return ranks[-1] if ranks else 0


def masked(s):
    n = len(s)
    a, b = n - len(s.lstrip("-")), n - len(s.rstrip("-"))
    return "?" * n if a == n else "?" * a + s[a : n - b] + "?" * b


def matrix(a, b, first, last):
    cols = [(x, y) for x, y in zip(a, b)][first : last + 1]
    if len(cols) < 25:
        return 0
    total = 0
    for x, y in cols:
        known = [c in sequence.AMINO for c in (x, y)]
        if "?" in (x, y) or not any(known):
            continue
        total += -4 if not all(known) else 4 if x == y else -1
    return total


def test_family(spark):
    rng = random.Random(5)
    base = [rng.choice(sequence.AMINO) for _ in range(60)]

    def row(changes):
        own = list(base)
        for _ in range(changes):
            own[rng.randrange(60)] = rng.choice(sequence.AMINO + "-")
        return "".join(own)

    members = [("f", f"m{k}", rng.choice([50, 51, 40, 30, 31, 20]), row(2 * k)) for k in range(7)]
    egts = [(k, "f", "-" * (k % 4) + row(6 + 3 * k)[k % 4 :]) for k in range(8)] + [(90, "none", row(3)), (91, "f", "-" * 60)]
    tree = taxonomy.lineages(spark.createDataFrame(NODES, "taxid int, parent int, rank int"))
    m = taxonomy.with_path(spark.createDataFrame(members, "family string, member string, taxid int, aligned string"), tree)
    got = {r["query"]: (r["property"], r["taxid"]) for r in modes.family(spark.createDataFrame(egts, "query int, family string, aligned string"), m, rule_matrix(), 30).collect()}
    for q, f, s in egts:
        own = [(matrix(masked(s), masked(x), 0, 99), n, t, masked(x)) for g, n, t, x in members if g == f]
        best = min(own, key=lambda o: (-o[0], o[1]), default=None)
        if best is None or best[0] < 30:
            assert got[q] == (f, 0)
            continue
        e = masked(s)
        first, last = len(e) - len(e.lstrip("?")), len(e.rstrip("?")) - 1
        others = [(float(x), rank_of(best[2], t)) for x, t in ((matrix(best[3], o[3], first, last), o[2]) for o in own) if x >= 30]
        rank, no_worse = mirror(matrix(best[3], best[3], first, last), best[0], others)
        cut = next((t for t in reversed(path(best[2])) if 0 < PATHS[t][1] <= rank), None)
        if cut is None or not no_worse:
            assert got[q] == (f, cut or 0), q
        else:
            assert got[q][1] == 0 or got[q][1] in path(best[2])


def test_ribosomal(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("ACGT") for _ in range(80))
    vary = lambda n: "".join(rng.choice("ACGT") if rng.random() < n else c for c in base)
    subjects = [(f"S{k}", [50, 51, 40, 30, 31, 20][k % 6], "ba"[k == 7], k % 3, vary(k / 60)) for k in range(8)]
    hits = []
    for q in range(6):
        order = rng.sample(range(8), 5)
        hits += [(q, n, f"S{k}", 95, 50, q, 0, 3, 52, 100.0 - (0 if q == 5 else n)) for n, k in enumerate(order)]
    tree = taxonomy.lineages(spark.createDataFrame(NODES, "taxid int, parent int, rank int"))
    a = taxonomy.with_path(spark.createDataFrame(subjects, "id string, taxid int, kingdom string, offset int, aligned string"), tree)
    h = spark.createDataFrame(hits, "query int, ord int, subject string, identity int, aln_len int, mismatches int, openings int, s_start int, s_end int, bitscore double")
    got = {r["query"]: r["taxid"] for r in modes.ribosomal(h, a).collect()}
    rows = {s[0]: ("?" * s[3] + s[4], s[1], s[2]) for s in subjects}

    def score(x, y, first, last):
        return sum(0 if "?" in (c, d) else 1 if c == d else -3 for c, d in list(zip(x, y))[first : last + 1])

    for q in range(6):
        own = [x for x in hits if x[0] == q]
        best, taxid, kingdom = rows[own[0][2]]
        if any(int(x[9]) == int(own[0][9]) and rows[x[2]][2] != kingdom for x in own[1:]):
            assert got[q] == 0
            continue
        shift = len(best) - len(best.lstrip("?"))
        first, last = shift + 2, shift + 52
        others = [(float(s), rank_of(taxid, rows[x[2]][1])) for x in own[1:] if rows[x[2]][2] == kingdom and (s := score(best, rows[x[2]][0], first, last)) > 0]
        query_score = 47 - 3 * q - (50 - (47 + q))
        rank, _ = mirror(float(score(best, best, first, last)), float(query_score), others)
        cut = next((t for t in reversed(path(taxid)) if 0 < PATHS[t][1] <= rank), 0)
        assert got[q] == cut, q


def test_no_worse_is_cut_by_alignment(spark):
    p = "array(" + ", ".join(f"named_struct('taxid', {t}, 'rank', {PATHS[t][1]})" for t in path(50)) + ")"
    rows = spark.createDataFrame([(1, 27, True, 8), (2, 27, True, 0), (3, 27, False, 8)], "query int, rank_id int, no_worse boolean, support int")
    rows = rows.withColumns({"path": F.expr(p), "self_score": F.lit(1.0), "query_score": F.lit(1.0)})
    assert {r["query"]: r["taxid"] for r in classify.assign(rows).collect()} == {1: 20, 2: 0, 3: 50}


def test_candidates(spark):
    rows = [
        ">pir|A|b kinase - Mus musculus (Strain X, substrain Y)", ">pir|A|b kinase - Mus musculus", ">pir|none", ">gi|1 x [Homo [sub] sapiens]", ">gi|1 x [a, b]", ">gi|1 broken ] here",
        ">gi|1 thing from Bos taurus", ">gi|1", ">gi|1 Rattus rattus x",
    ]
    got = [r["c"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, h string").transform(organisms.with_candidates, F.col("h"), "c").orderBy("k").collect()]
    assert got[0][:3] == ["mus musculus (strain x, substrain y)", "strain x, substrain y", "mus musculus x y"] and got[0][3:] == ["mus musculus x", "mus musculus", "mus"]
    assert got[1] == ["mus musculus", "mus"] and got[2] == [] and got[3][0] == "homo [sub] sapiens" and got[4] == ["a, b", "a"] and got[5] == []
    assert got[6][0] == "bos taurus" and got[7] == [] and got[8] == ["rattus rattus", "rattus"]


def test_banded(spark):
    def full(a, b):
        row = [-4 * j for j in range(len(b) + 1)]
        for i in range(1, len(a) + 1):
            now = [-4 * i]
            for j in range(1, len(b) + 1):
                now.append(max(row[j - 1] + (4 if a[i - 1] == b[j - 1] else -1), row[j] - 4, now[j - 1] - 4))
            row = now
        return row[-1]

    rng = random.Random(2)
    pairs = [("".join(rng.choice("ACD") for _ in range(rng.randrange(9))), "".join(rng.choice("ACD") for _ in range(rng.randrange(9)))) for _ in range(60)] + [("A" * 30, "A" * 5)]
    score = formats.banded_score({a + b: 4 if a == b else -1 for a in "ACD" for b in "ACD"})
    got = [r["s"] for r in spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", score("a", "b").alias("s")).orderBy("k").collect()]
    assert got[:-1] == [full(a, b) for a, b in pairs[:-1]] and got[-1] is None


def test_gap_columns_and_matrix(spark):
    rows = spark.createDataFrame([(1, "-A-C"), (2, "--.CG"), (3, "-")], "id int, aligned string")
    assert {r["id"]: r["aligned"] for r in organisms.without_gap_columns(rows).collect()} == {1: "AC", 2: "-CG", 3: ""}
    lines = spark.createDataFrame([(0, "   A  C  *"), (1, "A  5 -2 -4"), (2, "C -2  9 -4"), (3, "* -4 -4  1")], "ord int, value string")
    table = sequence.read_matrix(parsers.matrix(lines))
    pairs = spark.createDataFrame([("A", "A"), ("A", "C"), ("C", "-"), ("-", "X"), ("?", "A")], "a string, b string")
    assert [r["s"] for r in pairs.select(sequence.pair_score(F.col("a"), F.col("b"), table).alias("s")).collect()] == [5, -2, -4, 0, 0]


def test_fasta_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(parsers, "LINES", 3)
    text = ["junk", ">a one", "AC", "GT", "", "# no", "TT", ">b", "GG", ">c two words", "A", "C", "G", "T", "A"]
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text)] + [("g", k, x) for k, x in enumerate(text)], "file string, ord int, value string")
    got = sorted(tuple(r) for r in parsers.fasta(lines).collect())
    assert got == [(f, *r) for f in "fg" for r in (("a", "one", "ACGTTT"), ("b", "", "GG"), ("c", "two words", "ACGTA"))]


def test_name_variants(spark):
    rng = random.Random(7)
    words = ["Alpha", "Aleph", "A.", "beta", "Beta", "gamma", "a.beta", "environmental samples"]
    lines = [(k, " ".join(rng.choices(words, k=rng.randint(1, 3))), k) for k in range(200)] + [(200, "environmental samples", 200)]
    want = {}
    for t, name, _ in lines:
        if name == "environmental samples":
            continue
        key, n = name.lower(), 2
        while key in want:
            key, n = f"{name.lower()}|{n}", n + 1
        want[key] = t
        head, _, rest = name.partition(" ")
        if rest:
            want.setdefault(f"{head[0]}. {rest}".lower(), t)
            want.setdefault(f"{head[0]}.{rest}".lower(), t)
    got = parsers.name_variants(spark.createDataFrame(lines, "taxid int, name string, ord int").repartition(3)).collect()
    assert len(got) == len(want) and {r["name"]: r.taxid for r in got} == want


def test_fasta_files(spark, tmp_path):
    import gzip

    text = "# made by hand\n\n>a first one\r\nAC\r\nGT\r\n\n# note\n>b\n>c\tthird > of all\nAA\nCC"
    (tmp_path / "x.fa").write_bytes(text.encode())
    (tmp_path / "y.fa.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "z.fa").write_bytes(b"")
    want = {("a", "first one", "ACGT"), ("b", "", ""), ("c", "third > of all", "AACC")}
    for name in ("x.fa", "y.fa.gz"):
        assert {tuple(r) for r in parsers.fasta_files(spark, f"{tmp_path}/{name}").collect()} == want
    assert parsers.fasta_files(spark, f"{tmp_path}/z.fa").count() == 0
    assert parsers.fasta_files(spark, str(tmp_path)).count() == 6


def test_training_records(spark):
    nodes = [(1, 1, 0), (131567, 1, 0), (2, 131567, 1), (20, 2, 0), (21, 20, 5), (22, 21, 23), (23, 22, 27), (10239, 1, 1), (31, 10239, 27)]
    tree = taxonomy.lineages(spark.createDataFrame(nodes, "taxid int, parent int, rank int"))
    names = spark.createDataFrame([(t, f"n{t}") for t, _, _ in nodes], "taxid int, name string")
    rows = spark.createDataFrame([("s", 23, "AC"), ("t", 20, "GG"), ("u", 1, "")], "id string, taxid int, seq string")
    got = {r.id: r.record for r in organisms.training_records(rows, tree, names).collect()}
    assert got == {"s": ">s 1_root;2_n2;21_n21;22_n22\nAC", "t": ">t 1_root;2_n2\nGG", "u": ">u 1_root;\n"}
    lines = {r.line for r in organisms.training_taxa(rows, tree, names).collect()}
    assert lines == {"1*1_root*0*0*norank", "2*2_n2*1*1*superkingdom", "21*21_n21*2*2*phylum", "22*22_n22*21*3*genus"}
    with pytest.raises(Exception, match="no trained node above taxon 10239"):
        organisms.training_taxa(rows.withColumn("taxid", F.lit(31)), tree, names).collect()
    with pytest.raises(Exception, match="unknown taxon 99"):
        organisms.training_records(rows.withColumn("taxid", F.lit(99)), tree, names).collect()
    with pytest.raises(Exception, match="no name of taxon 20"):
        organisms.training_records(rows, tree, names.where("taxid <> 20")).collect()
    assert organisms.training_taxa(rows.limit(0), tree, names).count() == 1


def test_evalue_cutoff(spark):
    rows = spark.createDataFrame([("a", 5, "1e-5"), ("b", 6, "0.1"), ("c", 7, "-"), ("d", 8, None)], "query string, taxid int, evalue string").withColumn("path", F.array(F.struct("taxid")))
    got = {r["query"]: (r.taxid, r.path is None) for r in profile.unknown_above(rows, 1e-3).collect()}
    assert got == {"a": (5, False), "b": (0, True), "c": (7, False), "d": (8, False)}
    assert {r["query"] for r in profile.within(rows, 1e-3).collect()} == {"a", "c", "d"}
