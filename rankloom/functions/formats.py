"""Numbers as text with six significant digits, and banded global alignment."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _scientific(x: Column) -> Column:
    """[six digits with a dot, exponent] of a number's amount, rounded by the double's exact value, a true half to the even digit.

    That is how Spark's format_number rounds, but for whole numbers of seven digits and more, of which it takes true
    halves up: those are cut to the even digit before. Subnormal numbers are rounded by their shortest form.
    """
    amount = F.abs(x)
    whole = F.when((amount >= 1e6) & (amount < 9.2e18), amount.cast("long"))
    unit = F.get(F.array(*[F.lit(10**k) for k in range(14)]), F.length(whole.cast("string")) - 6).cast("long")
    down = (whole % unit * 2 == unit) & (F.floor(whole / unit) % 2 == 0) & (amount == whole.cast("double"))
    even = F.when((amount >= 1e6) & (amount < 9.2e18), F.when(down, (whole - whole % unit).cast("double")).otherwise(amount)).otherwise(amount)
    return F.split(F.call_function("format_number", even, F.lit("0.00000E0")), "E")


def _as_c(x: Column, text: Column) -> Column:
    digits, power = F.replace(F.get(text, F.lit(0)), F.lit("."), F.lit("")), F.get(text, F.lit(1)).try_cast("int")
    short = F.rtrim(digits, F.lit("0"))
    dotted = lambda whole, rest: F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    far = F.concat(dotted(F.substring(short, 1, 1), F.substring(short, F.lit(2), F.lit(9))), exponent)
    near = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), short)).otherwise(dotted(F.substring(digits, F.lit(1), power + 1), F.substring(short, power + 2, F.lit(9))))
    out = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").when((power < -4) | (power >= 6), far).otherwise(near)
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), out))


def six_digits(number: Column) -> Column:
    """A number with at most six significant digits as C's %g writes it: plain from 1e-4 up to 1e6, else with an exponent of two digits or more.

    All forms are cut from one text of six digits and an exponent, which is worked out wherever it is named; for many rows
    see with_six_digits.
    """
    return _as_c(number.cast("double"), _scientific(number.cast("double")))


def with_six_digits(rows: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """Adds numbers by name as texts of six_digits; each is rounded once, in a step of its own."""
    held = rows.withColumns({f"_x_{k}": x.cast("double") for k, x in numbers.items()})
    held = held.withColumns({f"_t_{k}": _scientific(F.col(f"_x_{k}")) for k in numbers})
    return held.withColumns({k: _as_c(F.col(f"_x_{k}"), F.col(f"_t_{k}")) for k in numbers}).drop(*[f"_{x}_{k}" for k in numbers for x in "xt"])


def waves(a: list[np.ndarray], b: list[np.ndarray], matrix: np.ndarray, band: int, indel: int) -> np.ndarray:
    """Scores of the global alignments of pairs of coded sequences within a band, whose lengths differ by `band` at most.

    Cells of one antidiagonal depend on the two before only, so each is one step for all pairs at once. A row of
    the band holds the cells by their distance from the diagonal; cells beyond a pair's end are worked out too, but
    its last cell never looks at them.
    """
    n, width, low = len(a), 2 * band + 1, -(1 << 40)
    len_a, len_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    most_a, most_b = int(len_a.max(initial=0)), int(len_b.max(initial=0))
    code_a, code_b = np.zeros((n, most_a), dtype=np.int64), np.zeros((n, most_b), dtype=np.int64)
    for k in range(n):
        code_a[k, : len_a[k]], code_b[k, : len_b[k]] = a[k], b[k]
    out, total = np.zeros(n, dtype=np.int64), len_a + len_b
    before, last = np.full((n, width + 2), low), np.full((n, width + 2), low)
    for t in range(int(total.max(initial=0)) + 1):
        now = np.full((n, width + 2), low)
        if not t:
            now[:, band + 1] = 0
        else:
            d = np.arange((band + t) % 2, width, 2)
            i = (t + band - d) // 2
            inside = (i >= 0) & (i <= t) & (i <= most_a) & (t - i <= most_b)
            d, i = d[inside], i[inside]
            best = np.maximum(last[:, d], last[:, d + 2]) + indel
            both = (i >= 1) & (t - i >= 1)
            pair = matrix[code_a[:, i[both] - 1], code_b[:, t - i[both] - 1]]
            best[:, both] = np.maximum(best[:, both], before[:, d[both] + 1] + pair)
            now[:, d + 1] = best
        ends = np.flatnonzero(total == t)
        out[ends] = now[ends, (len_b - len_a)[ends] + band + 1]
        before, last = last, now
    return out


def banded_score(scores: dict[str, int], band: int = 10, indel: int = -4, together: int = 256):
    """A function of two columns of sequences: the score of their global alignment within a band of the diagonal; null where the end lies outside it.

    Pairs of a batch are taken by length, `together` at a time, one step an antidiagonal for all of them. Pairs of
    letters without a score count 0.
    """
    letters = np.array(sorted({ord(c) for pair in scores for c in pair}), dtype=np.int64)
    matrix = np.zeros((len(letters) + 1,) * 2, dtype=np.int64)
    for (x, y), score in scores.items():
        matrix[np.searchsorted(letters, ord(x)), np.searchsorted(letters, ord(y))] = score

    def coded(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
        return np.where(letters[at] == points, at, len(letters))

    @F.pandas_udf("long")
    def banded(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype="Int64")
        fits = [k for k, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None and abs(len(x) - len(y)) <= band]
        fits.sort(key=lambda k: len(a.iloc[k]))
        for start in range(0, len(fits), together):
            part = fits[start : start + together]
            out.iloc[part] = waves([coded(a.iloc[k]) for k in part], [coded(b.iloc[k]) for k in part], matrix, band, indel)
        return out

    return banded


def columns(text: Column, separators: str | None = None, separator: str | None = None) -> Column:
    """The parts of a line between any of the characters `separators`, or between each `separator`, a string; empty parts are skipped.

    A line that ends in a separator raises: what should follow it is missing.
    """
    pattern = f"[{re.escape(separators)}]" if separators else re.escape(separator)
    parts = F.filter(F.split(text, pattern), lambda x: x != "")
    return F.when(F.regexp_like(text, F.lit(f"(?:{pattern})$")), F.raise_error(F.concat(F.lit("nothing after the last separator: "), text)).cast("array<string>")).otherwise(parts)
