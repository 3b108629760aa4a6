"""Scores of aligned rows against all members of their family, worked out in blocks.

A score adds up a matrix over the columns of two aligned rows, so a block of rows against a block of members is one
product of matrices: each row gives the scores of every letter at every column, each member the letters it has
there. A bound that could spare pairs would read the same columns as the score itself, so none is used.

Families are dealt into blocks of about BLOCK rows by hashes, on both sides; each pair of blocks is a group of its own,
so a hot family is spread over as many tasks as it has pairs of blocks. Only results folded within their block are
shuffled. Defined cases: rows alike count once; a null row or family meets no member; letters outside the alphabet
count as `*`, two of them and question marks as nothing; fewer than LEAST_COLUMNS compared columns score 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.sequence import AMINO

BLOCK, COLUMNS, LEAST_COLUMNS = 256, 64, 25
SKIP = len(AMINO) + 1
#: Below any score.
NONE = -(1 << 30)


def _table(matrix: dict[str, int]) -> np.ndarray:
    """Scores by codes: 0 for other letters, 1 and on for AMINO, SKIP for what is not compared."""
    table, letters = np.zeros((SKIP + 1, SKIP + 1), np.float32), "*" + AMINO
    for (x, y), score in matrix.items():
        if x in letters and y in letters and x + y != "**":
            table[letters.index(x), letters.index(y)] = score
    table[0] = table[:, 0]
    return table


def _codes(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters (a row each, SKIP beyond its end) and the lengths."""
    known = np.zeros(128, np.uint8)
    known[[ord(c) for c in AMINO]] = np.arange(1, SKIP)
    known[ord("?")] = SKIP
    each = [known[np.minimum(np.frombuffer(r.encode("utf-32-le"), "<u4"), 127)] for r in rows]
    lengths = np.array([len(r) for r in each], np.int64)
    out = np.full((len(each), int(lengths.max(initial=0))), SKIP, np.uint8)
    for k, r in enumerate(each):
        out[k, : len(r)] = r
    return out, lengths


def scores(rows: pd.Series, members: pd.Series, table: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Scores of all rows (down) with all members (across), of a row over the columns first to last."""
    a, a_lengths = _codes(rows)
    b, b_lengths = _codes(members)
    first = np.zeros(len(a), np.int64) if first is None else np.maximum(first, 0)
    last = a_lengths - 1 if last is None else last
    width = min(a.shape[1], b.shape[1])
    column = np.arange(width)
    a = np.where((column >= first[:, None]) & (column <= last[:, None]), a[:, :width], SKIP)
    total, letters = np.zeros((len(a), len(b))), np.arange(SKIP + 1)
    for at in range(0, width, COLUMNS):
        wanted = table[a[:, at : at + COLUMNS]].reshape(len(a), -1)
        there = (b[:, at : min(at + COLUMNS, width), None] == letters).astype(np.float32).reshape(len(b), -1)
        total += wanted @ there.T
    compared = np.minimum(np.minimum(a_lengths, last + 1)[:, None], b_lengths) - first[:, None]
    return np.where(compared < LEAST_COLUMNS, 0, total).astype(np.int64)


def _in_blocks(rows: DataFrame, members: DataFrame, block: int, fold, schema: str) -> DataFrame:
    """What fold gives of every pair of a block of rows and a block of members of one family."""
    rows, members = rows.distinct(), members.distinct()
    parts = lambda df, name: df.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = parts(rows, "_rows").join(parts(members, "_members"), "family")
    part = lambda df, name: F.pmod(F.xxhash64(*df.columns), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    keys = ["family", "_r", "_m"]
    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  (both sides may come from one table)
    left = rows.join(sizes, "family").withColumn("_r", part(rows, "_rows")).withColumn("_m", every("_members")).drop("_rows", "_members")
    right = members.join(sizes, "family").withColumn("_m", part(members, "_members")).withColumn("_r", every("_rows")).drop("_rows", "_members")
    return anew(left).groupBy(*keys).cogroup(anew(right).groupBy(*keys)).applyInPandas(fold, schema)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def best_members(rows: DataFrame, members: DataFrame, matrix: dict[str, int], block: int = BLOCK, others: bool = False) -> DataFrame:
    """query, family, row, score, member, taxid, m_row: the best member of rows (query, family, row) among members (family, member, taxid, m_row).

    Of equal scores the smallest member counts, then the smallest row; with `others`, a query is no member of its own.
    Rows whose family has no members are left out.
    """
    rows, members = rows.select("query", "family", "row").where("row is not null"), members.select("family", "member", "taxid", "m_row").where("m_row is not null")
    table = _table(matrix)

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query", "family", "row", "score", "member", "taxid", "m_row"])
        right = right.sort_values(["member", "m_row", "taxid"], kind="stable")
        found = scores(left["row"], right["m_row"], table)
        if others:
            found = np.where(left["query"].to_numpy()[:, None] == right["member"].to_numpy(), NONE, found)
        best = found.argmax(axis=1)
        chosen = right.iloc[best][["member", "taxid", "m_row"]].reset_index(drop=True)
        own = left[["query", "family", "row"]].reset_index(drop=True)
        out = pd.concat([own, pd.Series(found[np.arange(len(own)), best], name="score"), chosen], axis=1)
        return out[out["score"] > NONE]

    schema = f"query {_type(rows, 'query')}, family {_type(rows, 'family')}, row string, score int, member {_type(members, 'member')}, taxid {_type(members, 'taxid')}, m_row string"
    best = F.min(F.struct((-F.col("score")).alias("k"), "member", "m_row", "taxid")).alias("b")
    found = _in_blocks(rows, members, block, fold, schema).groupBy("query", "family", "row").agg(best)
    return found.select("query", "family", "row", (-F.col("b.k")).alias("score"), "b.member", "b.taxid", "b.m_row")


def score_ranges(rows: DataFrame, members: DataFrame, matrix: dict[str, int], least: int, block: int = BLOCK) -> DataFrame:
    """query, own, taxid, best, worst: for rows (query, family, own, row, first, last), the greatest and the least score from `least` on with members (family, taxid, m_row) of each taxon."""
    rows, members = rows.select("query", "family", "own", "row", "first", "last").where("row is not null"), members.select("family", "taxid", "m_row").where("m_row is not null")
    table = _table(matrix)

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query", "own", "taxid", "best", "worst"])
        found = scores(left["row"], right["m_row"], table, left["first"].to_numpy(np.int64), left["last"].to_numpy(np.int64))
        r, m = np.nonzero(found >= least)
        pairs = pd.DataFrame({"r": r, "taxid": right["taxid"].to_numpy()[m], "score": found[r, m]})
        out = pairs.groupby(["r", "taxid"], dropna=False)["score"].agg(best="max", worst="min").reset_index()
        return pd.DataFrame({"query": left["query"].to_numpy()[out["r"]], "own": left["own"].to_numpy()[out["r"]], "taxid": out["taxid"], "best": out["best"], "worst": out["worst"]})

    schema = f"query {_type(rows, 'query')}, own {_type(rows, 'own')}, taxid {_type(members, 'taxid')}, best int, worst int"
    each = _in_blocks(rows, members, block, fold, schema)
    return each.groupBy("query", "own", "taxid").agg(F.max("best").alias("best"), F.min("worst").alias("worst"))
