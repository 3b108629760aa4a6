"""Queries of parsers, lookups and sinks: lines are built from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import ranks
from rankloom.operators import joins as J
from rankloom.operators import sequences as Z
from rankloom.operators import taxonomy as T
from rankloom.plans import oracle as O
from rankloom.plans.registry import query
from rankloom.plans.taxonomy import tree
from rankloom.sources import parsers as P
from rankloom.sources import sinks as K
from rankloom.sources import tables as S


def line(*cells):
    return F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value")


@query("scan_nodes", O.sql("SELECT taxid, parent, rank FROM nodes", O.NODES))
def scan_nodes(spark, sf):
    return P.nodes(S.node_lines(spark, sf))


@query("scan_merged", O.sql("SELECT taxid, parent, rank FROM nodes UNION ALL SELECT 9000000 + c, 500000 + i23, 27 FROM k WHERE c % 50 = 0", O.NODES))
def scan_merged(spark, sf):
    c = S.table(spark, sf, "customer").where("c_custkey % 50 = 0").select(F.concat((9000000 + F.col("c_custkey")).cast("string"), F.lit("\t|\t"), (1000000 + F.col("c_custkey")).cast("string"), F.lit("\t|")).alias("value"))
    return T.with_merged(P.nodes(S.node_lines(spark, sf)), P.merged(c))


def name_rows(spark, sf):
    rows = S.names(spark, sf).withColumn("ord", F.col("taxid") * 2 + (F.col("class") == "synonym").cast("int"))
    text = F.concat_ws("\t|\t", F.col("taxid").cast("string"), "name", F.lit(""), F.concat("class", F.lit("\t|")))
    return P.names(rows.select(text.alias("value"), "ord"))


@query("scan_names", O.sql("SELECT lower(name) AS name, max_by(taxid, taxid) AS taxid FROM names GROUP BY lower(name)", O.NODES, O.NAMES))
def scan_names(spark, sf):
    return P.name_to_taxid(name_rows(spark, sf))


@query("scan_scinames", O.sql("SELECT taxid, lower(name) AS name FROM names WHERE class = 'scientific name'", O.NODES, O.NAMES))
def scan_scinames(spark, sf):
    return P.scientific_names(name_rows(spark, sf))


@query("scan_name_variants", O.sql(""", nm AS (SELECT taxid, name, taxid * 2 + (class = 'synonym')::INT AS ord FROM names UNION ALL SELECT 2000000 + p_partkey, p_name, (2000000 + p_partkey) * 2 FROM part),
fm AS (SELECT lower(name) AS name, 0 AS kind, ord, taxid FROM nm UNION ALL SELECT lower(name[1] || '.' || name[strpos(name, ' '):]), 1, ord, taxid FROM nm WHERE strpos(name, ' ') > 1
 UNION ALL SELECT lower(name[1] || '.' || name[strpos(name, ' ') + 1:]), 2, ord, taxid FROM nm WHERE strpos(name, ' ') > 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord, kind) AS place, count(*) FILTER (kind = 0) OVER (PARTITION BY name ORDER BY ord, kind) AS full_names, first_value(kind) OVER (PARTITION BY name ORDER BY ord, kind) AS first_kind FROM fm)
SELECT CASE WHEN place = 1 THEN name ELSE name || '|' || (full_names + (first_kind > 0)::INT) END AS name, taxid FROM pl WHERE place = 1 OR kind = 0""", O.NODES, O.NAMES))
def scan_name_variants(spark, sf):
    """Names of taxa and, as names that recur, those of parts."""
    parts = S.table(spark, sf, "part").select((2000000 + F.col("p_partkey")).cast("int").alias("taxid"), F.col("p_name").alias("name"))
    rows = name_rows(spark, sf).select("taxid", "name", F.col("ord").cast("long"))
    return P.name_variants(rows.unionByName(parts.withColumn("ord", F.col("taxid").cast("long") * 2)))


# A record for each document: header, and all its letters in lines of 60.
def fasta_lines(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", "[^A-Za-z]", "").alias("s"))
    parts = F.concat(F.array(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" "), "lang"), F.lit(""), F.lit("# note")), F.regexp_extract_all("s", F.lit(".{1,60}"), F.lit(0)))
    rows = d.select(F.concat(F.lit("f"), (F.col("doc_id") % 16).cast("string")).alias("file"), "doc_id", F.posexplode(parts).alias("k", "value"))
    return rows.select("file", (F.col("doc_id") * (1 << 20) + F.col("k")).alias("ord"), "value")


FASTA = "SELECT 'd' || doc_id AS id, lang AS description, regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq FROM documents"


@query("scan_fasta", FASTA)
def scan_fasta(spark, sf):
    return P.fasta(fasta_lines(spark, sf)).select("id", "description", "seq")


@query("fasta_to_map", f"SELECT id, seq FROM ({FASTA})")
def fasta_to_map(spark, sf):
    return P.fasta_by_id(P.fasta(fasta_lines(spark, sf)))


@query("scan_blast_m8", "SELECT l_orderkey::VARCHAR AS query, 'gi|' || l_partkey AS subject, (60 + l_suppkey % 40)::DOUBLE AS pct_identity, l_quantity::INT AS aln_len, l_linenumber AS mismatches, (l_suppkey % 3)::INT AS gap_openings, l_linenumber + 1 AS q_start, l_linenumber + 2 AS q_end, l_linenumber + 3 AS s_start, l_linenumber + 4 AS s_end, 1e-5::DOUBLE AS evalue, l_extendedprice AS bitscore FROM lineitem")
def scan_blast_m8(spark, sf):
    r = S.table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    cells = [F.col("l_orderkey"), F.concat(F.lit("gi|"), F.col("l_partkey").cast("string")), 60 + F.col("l_suppkey") % 40, F.col("l_quantity").cast("int"), n, F.col("l_suppkey") % 3, n + 1, n + 2, n + 3, n + 4, F.lit("1e-5"), F.col("l_extendedprice")]
    plain, surplus = line(*cells), line(cells[0], F.lit("x"), *cells[1:])
    rows = r.select(F.when(n % 2 == 0, plain).otherwise(surplus).alias("value"), F.lit(0).alias("ord"))
    return P.blast_m8(rows).drop("ord")


def m8_file(spark, sf):
    """One file of tabular hits in order: a comment for every order, and its hits; every seventh query comes back at the end."""
    k = F.col("o_orderkey")
    head = S.table(spark, sf, "orders").select((k * 64).alias("ord"), F.concat(F.lit("# Query: q"), k.cast("string"), F.lit(" text")).alias("value"))
    h, one = S.hits(spark, sf), F.lit(1)
    place = F.when((F.col("query") % 7 == 0) & (F.col("ord") > 2), F.col("query") * 64 + (1 << 40)).otherwise(F.col("query") * 64)
    rows = h.select((place + F.col("ord")).alias("ord"), line(F.concat(F.lit("q"), F.col("query").cast("string")), F.col("taxid"), *[one] * 9, F.col("score")))
    return head.unionByName(rows)


@query("m8_groups", O.sql("""SELECT g, query, n_hits, score FROM (
 SELECT query * 64 AS g, 'q' || query AS query, count(*) FILTER (NOT late) AS n_hits, max(score) FILTER (NOT late)::DOUBLE AS score FROM (SELECT o_orderkey AS query, score, coalesce(query % 7 = 0 AND ord > 2, score IS NULL) AS late FROM orders LEFT JOIN hits ON query = o_orderkey) GROUP BY query
 UNION ALL SELECT query * 64 + 1099511627776 + min(ord), 'q' || query, count(*), max(score)::DOUBLE FROM hits WHERE query % 7 = 0 AND ord > 2 GROUP BY query)""", O.NODES, O.HITS))
def m8_groups(spark, sf):
    """Groups of tabular hits: a new one wherever the query changes, empty ones for comments without hits."""
    rows = P.m8_groups(m8_file(spark, sf))
    return rows.groupBy(F.col("group").alias("g"), "query").agg(F.count("bitscore").alias("n_hits"), F.max("bitscore").alias("score"))


@query("blast_field_extract", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS bitscore, l_discount AS evalue, l_suppkey::INT AS identities, (l_suppkey + 50)::INT AS aln_len, (l_suppkey % 90)::INT AS percent, (l_suppkey + 1)::INT AS positives, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END AS gaps, CASE WHEN l_linenumber % 2 = 0 THEN -3 ELSE 2 END AS frame, l_partkey::INT AS seq_start, (l_partkey + 4)::INT AS seq_end FROM lineitem")
def blast_field_extract(spark, sf):
    """All fields, each from the line that holds it."""
    s = lambda c: c.cast("string")
    n, even = F.col("l_suppkey"), F.col("l_linenumber") % 2 == 0
    gaps = F.when(even, F.concat(F.lit(", Gaps = "), s(F.col("l_linenumber")), F.lit("/"), s(n + 50))).otherwise("")
    lines = [
        F.concat(F.lit(" Score = "), s(F.col("l_extendedprice")), F.lit(" bits (300), Expect(2) = "), s(F.col("l_discount"))),
        F.concat(F.lit(" Identities = "), s(n), F.lit("/"), s(n + 50), F.lit(" ("), s(n % 90), F.lit("%), Positives = "), s(n + 1), F.lit("/"), s(n + 50), F.lit(" (1%)"), gaps),
        F.concat(F.lit(" Frame = "), F.when(even, "-3").otherwise("+2")),
        F.concat(F.lit("Query: "), s(F.col("l_partkey")), F.lit(" MK-VL "), s(F.col("l_partkey") + 4)),
    ]
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows, fields = S.table(spark, sf, "lineitem").select(*keys, *[x.alias(f"_{k}") for k, x in enumerate(lines)]), P.blast_fields()
    for k in range(len(lines)):
        rows = rows.withColumn("value", F.col(f"_{k}")).withColumns({f"{name}_{k}": c for name, c in fields.items()})
    return rows.select(*keys, *[F.coalesce(*[F.col(f"{name}_{k}") for k in range(len(lines))]).alias(name) for name in fields])


@query("scan_blast_report", """SELECT 'BLASTX' AS "match", l_orderkey::VARCHAR AS query, 'gi|' || l_partkey || ' part' AS subject, 0 AS hsp, l_extendedprice AS bitscore, 1e-9::DOUBLE AS evalue, l_suppkey::INT AS identities, 900 AS aln_len, 10 AS percent, l_suppkey::INT AS positives, 0 AS gaps,
 CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS frame, 1 AS q_start, 9 AS q_end, 5 AS s_start, 13 AS s_end, 'ACGTAC' AS q_seq, 'ACGTTT' AS s_seq FROM lineitem""")
def scan_blast_report(spark, sf):
    """A report record for each order, read back: wrapped alignments, in frames and on strands."""
    s = lambda c: F.col(c).cast("string")
    minus = F.col("l_linenumber") % 2 == 0
    wrapped = lambda ends: F.concat(*[F.lit(f"\n\nQuery: {a} {x} {b}\n         ||||\nSbjct: {c} {y} {d}\n") for (a, b), x, (c, d), y in zip(ends, ("ACGT", "AC"), ((5, 8), (9, 13)), ("ACGT", "TT"))])
    ends = F.when(minus, F.concat(F.lit(" Strand = Plus / Minus"), wrapped(((9, 6), (5, 1))))).otherwise(F.concat(F.lit(" Frame = +1"), wrapped(((1, 4), (5, 9)))))
    hit = F.concat(F.lit("\n>gi|"), s("l_partkey"), F.lit(" part\n          Length = 90\n\n Score = "), s("l_extendedprice"), F.lit(" bits (9), Expect = 1e-9\n Identities = "), s("l_suppkey"), F.lit("/900 (10%), Positives = "), s("l_suppkey"), F.lit("/900 (10%)\n"), ends)
    rows = S.table(spark, sf, "lineitem").select("l_orderkey", hit.alias("hit")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("hit"), "").alias("hits"))
    return P.blast_report(rows.select(F.concat(F.lit("BLASTX 2.2\n\nQuery= "), s("l_orderkey"), F.lit("\n"), "hits").alias("value"))).drop("hit", "entries")


def listed_others(rows):
    """The taxa of the other scores as one text."""
    return rows.withColumn("others", F.array_join(F.transform("others", lambda o: F.concat(o["taxid"].cast("string"), F.lit(":"), F.floor(o["score"]).cast("string"))), ","))


@query("scan_reciprocal_m8", O.sql("SELECT query::VARCHAR AS \"group\", max(score) FILTER (ord = 1)::DOUBLE AS self_score, coalesce(max(score) FILTER (ord = 2), min(score))::DOUBLE AS query_score, count(*) FILTER (ord > 2) AS n_others, coalesce(string_agg(taxid || ':' || score, ',' ORDER BY ord) FILTER (ord > 2), '') AS others FROM (SELECT query, ord, score, taxid FROM (SELECT *, CASE ord WHEN 1 THEN 'self' WHEN 2 THEN 'query' ELSE taxid::VARCHAR END AS subj FROM hits) QUALIFY lag(subj) OVER (PARTITION BY query ORDER BY ord) IS DISTINCT FROM subj) GROUP BY query", O.NODES, O.HITS))
def scan_reciprocal_m8(spark, sf):
    h = S.hits(spark, sf)
    subject = F.when(F.col("ord") == 1, "self").when(F.col("ord") == 2, "query").otherwise(F.col("taxid").cast("string"))
    one = F.lit(1)
    lines = h.select(line(F.col("query"), subject, one, one, one, one, one, one, one, one, one, F.col("score")), "ord")
    rows = P.blast_m8(lines).select(F.col("query").alias("group"), "ord", "subject", "bitscore")
    return listed_others(P.reciprocal_m8(rows))


@query("scan_hmmscan", "SELECT 'PF' || l_partkey AS accession, l_orderkey::VARCHAR AS read, CASE WHEN l_linenumber = 1 THEN 0 ELSE -l_linenumber END AS frame, l_linenumber AS ali_from, (l_linenumber + l_quantity::INT)::INT AS ali_to FROM lineitem WHERE l_quantity::INT > 10")
def scan_hmmscan(spark, sf):
    s = lambda c: c.cast("string")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    name = F.concat(s(F.col("l_orderkey")), F.when(n == 1, "_blastx").otherwise(F.concat(F.lit("_-"), s(n))))
    end = F.when(q > 10, n + q).otherwise(n)
    cells = [F.lit("fam"), F.concat(F.lit("PF"), s(F.col("l_partkey"))), F.lit("7"), name, F.lit("-"), F.lit("9"), F.lit("1e-7"), *[F.lit("0")] * 5, F.lit("2e-6"), *[F.lit("0")] * 4, s(n), s(end)]
    return P.hmmscan(S.table(spark, sf, "lineitem").select(F.concat_ws("   ", *cells).alias("value"))).select("accession", "read", "frame", "ali_from", "ali_to")


@query("scan_egt", "SELECT p_brand AS pfam, 'r' || p_partkey || '_1_2' AS read, '1e-05' AS evalue, replace(p_name, ' ', ',') AS go, repeat('MK', p_size) AS seq FROM part WHERE p_size >= 5")
def scan_egt(spark, sf):
    p = S.table(spark, sf, "part")
    rows = p.select(P.egt_line(F.col("p_brand"), F.concat(F.lit("r"), F.col("p_partkey").cast("string"), F.lit("_1_2")), F.lit("1e-05"), F.split("p_name", " ")).alias("header"), F.repeat(F.lit("MK"), F.col("p_size")).alias("seq"))
    return P.egt(rows).select("pfam", "read", "evalue", F.array_join("go", ",").alias("go"), "seq")


@query("scan_rdp_header", "SELECT 'S' || c_custkey AS id, c_name AS organism, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 100)::INT ELSE 0 END AS off FROM customer")
def scan_rdp_header(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(F.lit(">S"), k.cast("string"), F.lit(" "), F.col("c_name"), F.when(k % 2 == 0, F.concat(F.lit("; OFFSET"), (k % 100).cast("string"))).otherwise(F.lit("; x")))
    return P.rdp_header(S.table(spark, sf, "customer").select(text.alias("value"))).withColumnRenamed("offset", "off")


@query("scan_rna_alignment", "SELECT 'S' || c_custkey AS id, (1000000 + c_custkey)::INT AS taxid, (c_custkey % 9)::INT AS off FROM customer")
def scan_rna_alignment(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(F.lit(">S"), k.cast("string"), F.lit("_"), (1000000 + k).cast("string"), F.lit(" OFFSET"), (k % 9).cast("string"))
    return P.rna_header(S.table(spark, sf, "customer").select(text.alias("value"))).withColumnRenamed("offset", "off")


@query("scan_obo", "SELECT 'GO:' || p_partkey AS go_id, p_name AS name, p_type AS namespace, CASE WHEN p_size % 2 = 0 THEN 'GO:' || (p_partkey + 1000000) ELSE '' END AS alt FROM part")
def scan_obo(spark, sf):
    s = F.col("p_partkey").cast("string")
    alt = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("alt_id: GO:"), (F.col("p_partkey") + 1000000).cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("\nid: GO:"), s, F.lit("\nname: "), "p_name", F.lit("\nnamespace: "), "p_type", F.lit("\n"), alt)
    return P.obo(S.table(spark, sf, "part").select(text.alias("value"))).select("go_id", "name", "namespace", F.array_join("alt_ids", ",").alias("alt"))


@query("scan_pfam_taxid", "SELECT c_name || '_X' AS pfam_seq_id, (1000000 + c_custkey)::INT AS taxid FROM customer")
def scan_pfam_taxid(spark, sf):
    return P.pfam_taxid(S.table(spark, sf, "customer").select(F.concat("c_name", F.lit("_X,"), (1000000 + F.col("c_custkey")).cast("string")).alias("value")))


@query("scan_pfam_go", "SELECT p_brand AS acc, string_agg('GO:' || p_size, ',' ORDER BY p_partkey) AS go FROM part GROUP BY p_brand")
def scan_pfam_go(spark, sf):
    p = S.table(spark, sf, "part")
    q = lambda *c: F.concat_ws("\t", *[F.concat(F.lit("'"), x.cast("string"), F.lit("'")) for x in c]).alias("value")
    families = P.quoted(p.select(F.xxhash64("p_brand").alias("h"), "p_brand").distinct().select(q(F.col("h"), F.col("p_brand"))), 2).select(F.col("c")[0].alias("auto_id"), F.col("c")[1].alias("acc"))
    lines = p.select(q(F.xxhash64("p_brand"), F.concat(F.lit("GO:"), F.col("p_size").cast("string")), F.col("p_partkey")))
    ontology = P.quoted(lines, 3).select(F.col("c")[0].alias("auto_id"), F.col("c")[1].alias("go_id"), F.col("c")[2].cast("long").alias("ord"))
    return P.pfam_go(families, ontology)


@query("build_pfam_taxid", "SELECT 'P' || p_partkey AS id, p_size::INT AS taxid FROM part")
def build_pfam_taxid(spark, sf):
    """Quoted rows of which every third is broken into two lines."""
    k = F.col("p_partkey")
    q = lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))
    head, tail = F.concat_ws("\t", F.lit("'0'"), q(F.concat(F.lit("P"), k.cast("string"))), *[F.lit("''")] * 5), F.concat_ws("\t", *[F.lit("''")] * 8, q(F.col("p_size")), F.lit("''"))
    whole = F.array(F.concat(head, F.lit("\t"), tail))
    parts = F.when(k % 3 == 0, F.array(F.concat(head, F.lit("\t\\")), tail)).otherwise(whole)
    rows = S.table(spark, sf, "part").select(k, F.posexplode(parts).alias("at", "value"))
    return P.pfam_taxid_table(rows.select((k * 2 + F.col("at")).alias("ord"), "value"))


@query("scan_stockholm", "SELECT 's' || doc_id || '/1-9' AS row_id, upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) || 'AC' AS aligned FROM documents")
def scan_stockholm(spark, sf):
    """A file for each document; where there is no text, its row is named only."""
    d = S.table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", ".").alias("s"))
    name = F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.lit("/1-9 "))
    parts = F.array(F.lit("# STOCKHOLM 1.0"), F.coalesce(F.concat(name, "s"), name), F.when(F.col("s").isNotNull(), F.concat(name, F.lit("ac"))).otherwise("# no text"), F.lit("//"), F.concat(name, F.lit("zz")))
    rows = d.select(F.col("doc_id").alias("file"), F.posexplode(parts).alias("ord", "value"))
    return P.stockholm(rows).select("row_id", "aligned")


@query("scan_matrix", "SELECT a.n_nationkey::VARCHAR AS a, b.n_nationkey::VARCHAR AS b, (a.n_nationkey * 10 - b.n_nationkey)::INT AS score FROM nation a, nation b")
def scan_matrix(spark, sf):
    n = S.table(spark, sf, "nation").select("n_nationkey")
    listed = n.agg(F.array_sort(F.collect_list("n_nationkey")).alias("all"))  # 25 rows
    body = n.join(F.broadcast(listed)).select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.array_join(F.transform("all", lambda x: (F.col("n_nationkey") * 10 - x).cast("string")), "  ")).alias("value"), (F.col("n_nationkey") + 1).alias("ord"))
    head = listed.select(F.concat(F.lit("   "), F.array_join(F.transform("all", lambda x: x.cast("string")), "  ")).alias("value"), F.lit(0).alias("ord"))
    return P.matrix(head.unionByName(body))


@query("gi_dump", O.sql("SELECT c_custkey::BIGINT AS gi, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1000000 + c_custkey END::INT AS taxid, repeat(c_mktsegment, 3) AS seq FROM customer UNION ALL SELECT c_custkey + 1000000, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1000000 + c_custkey END, repeat(c_mktsegment, 3) FROM customer"))
def gi_dump(spark, sf):
    """Headers that list two entries; the first, the second or none of them names a taxon."""
    k = F.col("c_custkey")
    mark = lambda own: F.when(own, F.concat(F.lit(" ["), "c_name", F.lit("]"))).otherwise(" [no such]")
    text = F.concat(F.lit(">gi|"), k.cast("string"), F.lit("|x protein"), mark(k % 4 == 1), F.lit(" >gi|"), (k + 1000000).cast("string"), F.lit("|y protein"), mark(k % 4 > 1))
    rows = S.table(spark, sf, "customer").select(text.alias("header"), F.repeat("c_mktsegment", F.lit(3)).alias("seq"))
    return Z.dumped(rows, P.name_to_taxid(name_rows(spark, sf)))


# Lookups.
@query("join_taxid_name", O.sql("SELECT query, ord, coalesce(lower(name), 'unknown') AS name FROM hits LEFT JOIN (SELECT * FROM names WHERE class = 'scientific name') n ON hits.taxid = n.taxid", O.NODES, O.NAMES, O.HITS))
def join_taxid_name(spark, sf):
    known = P.scientific_names(name_rows(spark, sf))
    return S.hits(spark, sf).join(known, "taxid", "left").select("query", F.col("ord").cast("long").alias("ord"), F.coalesce("name", F.lit("unknown")).alias("name"))


@query("join_name_taxid", O.sql("SELECT c_custkey AS c, taxid FROM customer LEFT JOIN (SELECT lower(name) AS nm, max(taxid) AS taxid FROM names GROUP BY 1) ON lower(CASE WHEN c_custkey % 3 = 0 THEN 'no such' ELSE c_name END) = nm", O.NODES, O.NAMES))
def join_name_taxid(spark, sf):
    text = F.lower(F.when(F.col("c_custkey") % 3 == 0, "no such").otherwise(F.col("c_name")))
    return S.table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), text.alias("name")).join(P.name_to_taxid(name_rows(spark, sf)), "name", "left").select("c", "taxid")


@query("join_name_backoff", O.sql(""", known AS (SELECT lower(name) AS name, max_by(taxid, taxid) AS taxid FROM names GROUP BY 1),
asked AS (SELECT c_custkey AS c, string_split(lower(CASE c_custkey % 5 WHEN 0 THEN 'Syn ' || c_name || ' x 1' WHEN 1 THEN c_name || ' strain 12' WHEN 2 THEN 'no such thing' WHEN 3 THEN c_name ELSE 'abc ' || c_name END), ' ') AS w FROM customer),
begun AS (SELECT c, unnest(list_transform(range(1, len(w) + 1), lambda k: array_to_string(w[1:k], ' '))) AS name FROM asked),
hit AS (SELECT c, max_by(taxid, length(begun.name)) AS taxid FROM begun JOIN known USING (name) WHERE length(begun.name) >= 4 GROUP BY c)
SELECT c_custkey AS c, taxid FROM customer LEFT JOIN hit ON c = c_custkey""", O.NODES, O.NAMES))
def join_name_backoff(spark, sf):
    """Names with more behind them, synonyms, and texts that name nothing."""
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, F.concat(F.lit("Syn "), "c_name", F.lit(" x 1"))).when(k == 1, F.concat("c_name", F.lit(" strain 12"))).when(k == 2, "no such thing").when(k == 3, F.col("c_name")).otherwise(F.concat(F.lit("abc "), "c_name"))
    rows = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), text.alias("organism"))
    return J.by_longest_prefix(rows, "c", "organism", P.name_to_taxid(name_rows(spark, sf))).select("c", "taxid")


@query("join_gi", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(p_size, 0) AS taxid FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) ON l_partkey = p_partkey")
def join_gi(spark, sf):
    known = S.table(spark, sf, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return rows.join(known, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.coalesce("p_size", F.lit(0)).alias("taxid"))


@query("join_pfam_go", "SELECT p_partkey, '{' || coalesce(go, '') || '}' AS go FROM part LEFT JOIN (SELECT 'PF' || lpad(p_size::VARCHAR, 5, '0') AS acc, string_agg('GO:' || p_partkey, ',' ORDER BY p_partkey) AS go FROM part WHERE p_size > 25 GROUP BY 1) ON acc = 'PF' || lpad(p_size::VARCHAR, 5, '0')")
def join_pfam_go(spark, sf):
    """Properties with a version behind the accession; families of small parts have no terms."""
    p = S.table(spark, sf, "part").withColumn("acc", F.concat(F.lit("PF"), F.lpad(F.col("p_size").cast("string"), 5, "0")))
    families = p.where("p_size > 25").select("acc", F.col("p_size").alias("auto_id")).distinct()
    ontology = p.where("p_size > 25").select(F.col("p_size").alias("auto_id"), F.concat(F.lit("GO:"), F.col("p_partkey").cast("string")).alias("go_id"), F.col("p_partkey").alias("ord"))
    return J.with_go(p.select("p_partkey", F.concat("acc", F.lit(".7")).alias("property")), P.pfam_go(families, ontology)).select("p_partkey", "go")


@query("sink_classification", O.sql("""SELECT l.taxid::VARCHAR || chr(9) || 'PF1' || chr(9) || '{}' || chr(9) || l.taxid || chr(9) || CASE WHEN l.taxid <= 1 THEN 'unknown' ELSE path END || chr(9) || '1e-5' AS line FROM
 (SELECT taxid, string_agg(coalesce(lower(n.name), 'unknown'), '!' ORDER BY pos) AS path FROM (SELECT taxid, unnest(ids) AS node, generate_subscripts(ids, 1) AS pos FROM lin) x LEFT JOIN (SELECT taxid AS t, name FROM names WHERE class = 'scientific name') n ON n.t = node GROUP BY taxid) l""", *O.TREE_NAMES))
def sink_classification(spark, sf):
    rows = tree(spark, sf).select(F.col("taxid").cast("string").alias("query"), F.lit("PF1").alias("property"), F.lit("{}").alias("go"), "taxid", "path", F.lit("1e-5").alias("evalue"))
    return K.classification_lines(rows, P.scientific_names(name_rows(spark, sf)))


@query("sink_egt", "SELECT '>' || p_brand || '=+=r' || p_partkey || '=+=1e-05=+={' || replace(p_name, ' ', ',') || '}' || chr(10) || 'MK' AS record FROM part")
def sink_egt(spark, sf):
    head = P.egt_line(F.col("p_brand"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")), F.lit("1e-05"), F.split("p_name", " "))
    return K.fasta_records(S.table(spark, sf, "part").select(head.alias("header"), F.lit("MK").alias("seq")))


@query("greedy_family_bins")
def greedy_family_bins(spark, sf):
    """Families dealt to the least loaded of eight bins."""
    sizes = S.table(spark, sf, "part").groupBy(F.col("p_brand").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return J.greedy_bins(sizes, 8)
