"""The adapters of sources/tables.py as DuckDB common table expressions."""

CUSTOMERS = """
k0 AS (SELECT c_custkey AS c, c_nationkey AS n, c_name, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS s FROM customer),
k1 AS (SELECT *, n * 10 + s AS i8 FROM k0),
k2 AS (SELECT *, i8 * 3 + c % 3 AS i14 FROM k1),
k3 AS (SELECT *, i14 * 5 + c % 5 AS i19 FROM k2),
k AS (SELECT *, i19 * 7 + c % 7 AS i23 FROM k3)"""

NODES = CUSTOMERS + """,
reg(rk, taxid, rank, parent) AS (VALUES (0, 2, 1, 131567), (1, 2157, 1, 131567), (2, 2759, 1, 131567), (3, 10239, 1, 1), (4, 12908, 0, 1)),
nodes AS (
  SELECT 1 AS taxid, 1 AS parent, 0 AS rank UNION ALL SELECT 131567, 1, 0
  UNION ALL SELECT taxid, parent, rank FROM reg
  UNION ALL SELECT 100000 + n_nationkey, reg.taxid, 5 FROM nation JOIN reg ON n_regionkey = rk
  UNION ALL SELECT DISTINCT 200000 + i8, 100000 + n, 8 FROM k
  UNION ALL SELECT DISTINCT 300000 + i14, 200000 + i8, 14 FROM k
  UNION ALL SELECT DISTINCT 400000 + i19, 300000 + i14, 19 FROM k
  UNION ALL SELECT DISTINCT 500000 + i23, 400000 + i19, 23 FROM k
  UNION ALL SELECT 1000000 + c, 500000 + i23, 27 FROM k)"""

LINEAGES = NODES + """,
lin AS (
  SELECT taxid, rank, [taxid] AS ids, [rank] AS rks FROM nodes WHERE taxid = 1
  UNION ALL
  SELECT x.taxid, x.rank, list_append(l.ids, x.taxid), list_append(l.rks, x.rank) FROM nodes x JOIN lin l ON x.parent = l.taxid WHERE x.taxid <> 1)"""

NAMES = """,
names AS (
  SELECT taxid, r_name AS name, 'scientific name' AS class FROM region JOIN reg ON r_regionkey = rk
  UNION ALL SELECT 100000 + n_nationkey, n_name, 'scientific name' FROM nation
  UNION ALL SELECT 1000000 + c, c_name, 'scientific name' FROM k
  UNION ALL SELECT 1000000 + c, 'Syn ' || c_name, 'synonym' FROM k WHERE c % 10 = 0)"""

HITS = """,
hits AS (
  SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ord,
    CASE l_partkey % 8 WHEN 3 THEN 500000 + i23 WHEN 4 THEN 400000 + i19 WHEN 5 THEN 300000 + i14 WHEN 6 THEN 200000 + i8
      WHEN 7 THEN 1000000 + (c + l_suppkey) % (SELECT count(*) FROM customer) ELSE 1000000 + c END AS taxid,
    round(l_extendedprice * 100)::BIGINT AS score, l_quantity::INT AS aln_len, round(l_discount * 100)::INT AS ev,
    l_partkey AS part, l_suppkey AS supp, o_orderpriority AS sample, c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN k ON o_custkey = c)"""

PATHS = """,
ph AS (SELECT h.*, l.ids, l.rks FROM hits h JOIN lin l ON h.taxid = l.taxid)"""


def sql(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + "".join(parts).lstrip() + " " + body if parts else body


TREE = (LINEAGES,)
TREE_NAMES = (LINEAGES, NAMES)
TREE_HITS = (LINEAGES, HITS, PATHS)
ALL = (LINEAGES, NAMES, HITS, PATHS)
