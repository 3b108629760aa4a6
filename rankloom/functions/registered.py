"""Functions that queries in SQL text can call, once register(spark) has been called."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from rankloom.functions import ranks
from rankloom.sources import parsers

#: Name: arguments, type of the result, and its expression in SQL.
FUNCTIONS = {
    "taxon_lca": ("a ARRAY<INT>, b ARRAY<INT>", "INT", "coalesce(get(a, size(array_intersect(a, b)) - 1), 0)"),
    "common_path_length": ("a ARRAY<INT>, b ARRAY<INT>", "INT", "size(array_intersect(a, b))"),
    "simple_rank": ("r INT", "INT", "CASE " + " ".join(f"WHEN r >= {least} THEN {k}" for k, least in enumerate(ranks.SIMPLE)) + " ELSE 7 END"),
    "rank_name": ("r INT", "STRING", "get(array(" + ", ".join(f"'{r}'" for r in ranks.RANKS) + "), r)"),
    "reverse_complement": ("s STRING", "STRING", "translate(reverse(regexp_replace(s, '[^ACGTU]', 'N')), 'ACGTU', 'TGCAC')"),
    "dna_region": ("s STRING, a INT, b INT", "STRING", "CASE WHEN a > b THEN translate(reverse(regexp_replace(substring(s, b, a - b + 1), '[^ACGTU]', 'N')), 'ACGTU', 'TGCAC') ELSE substring(s, a, b - a + 1) END"),
    "overlap_fraction": ("a1 INT, a2 INT, b1 INT, b2 INT", "DOUBLE", "greatest(0, least(a2, b2) - greatest(a1, b1) + 1) / (a2 - a1 + 1)"),
    "read_of": ("name STRING", "STRING", "regexp_replace(name, '_[+-]?[0-9]_[+-]?[0-9]$', '')"),
}


@udtf(returnType=parsers.REPORT)
class SearchReport:
    """The alignments of a report's record, one row each."""

    def eval(self, text: str) -> Iterator[tuple]:
        columns = [c.split()[0] for c in parsers.REPORT.split(", ")]
        for row in parsers.report_record(text or ""):
            yield tuple(row[c] for c in columns)


def register(spark: SparkSession) -> None:
    """Registers FUNCTIONS as SQL functions, which the optimiser sees through, and search_report(text) as a table function."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("search_report", SearchReport)
