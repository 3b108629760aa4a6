"""Cuts of packed documents against a plain form, and what the helpers of running totals ask of the driver."""

import random
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from rankloom.llm import common, packing


def table(lengths, deal, skip=0):
    rows, at = [], 0
    for k, n in enumerate(lengths):
        ids = np.array([deal.randrange(90_000 if k % 3 == 0 else 60_000) for _ in range(n)], "<u4")
        wide = bool(ids.max() > 0xFFFF)
        cuts = sorted({0, n, *(deal.randrange(n) for _ in range(4))})
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            at += deal.randrange(3)
            parts.append({"start": a, "size": b - a, "at": at})
            at += b - a
        deal.shuffle(parts)
        rows.append({"doc_id": k if k % 4 else None, "n": n, "body": bytes([wide]) + zstandard.compress(ids.astype("<u4" if wide else "<u2").tobytes()), "parts": parts[skip:], "ids": ids})
    return rows


def test_cut_as_plain_form(monkeypatch):
    rows, want = table([1, 7, 64, 65, 1000, 1, 333], random.Random(2)), []
    for r in rows:
        for p in sorted(r["parts"], key=lambda p: p["start"]):
            for k in range(p["size"]):  # id by id, then runs of a sequence
                place, start = p["at"] + k, p["start"] + k
                if k and place % 64:
                    want[-1][2] += 1
                    want[-1][3] += r["ids"][start].tobytes()
                else:
                    want.append([r["doc_id"], start, 1, r["ids"][start].tobytes(), r["n"], place // 64, place % 64])
    whole = pa.Table.from_pylist([{k: r[k] for k in ("doc_id", "n", "body", "parts")} for r in rows]).combine_chunks()
    for most in (100, 3):
        out = pa.Table.from_batches(list(packing._cut(64)(iter(whole.to_batches(max_chunksize=most)))))
        assert out.schema == packing.PIECES and [list(r.values()) for r in out.to_pylist()] == want


def test_cut_misses_no_id():
    whole = pa.Table.from_pylist([{k: r[k] for k in ("doc_id", "n", "body", "parts")} for r in table([500, 500], random.Random(3), skip=1)])
    with pytest.raises(ValueError, match="each id once"):
        list(packing._cut(64)(iter(whole.to_batches())))


def test_buckets_ask_little_of_the_driver(spark, monkeypatch):
    """A binary search among 2,000 bounds, and the bounds themselves, need some literals, not one for each."""
    bounds = sorted({-(2**63), 2**63 - 1, *random.Random(4).sample(range(-(10**18), 10**18), 1_998)})
    keys = [None, 0, *bounds[:3], *bounds[-3:], *(b + d for b in bounds[500:520] for d in (-1, 1))]
    calls, own = [], F.lit
    monkeypatch.setattr(F, "lit", lambda x: calls.append(x) or own(x))
    found = spark.createDataFrame([(k,) for k in keys], "k long").select("k", common.bucket_of(F.col("k"), bounds).alias("b")).collect()
    assert [r["b"] for r in found] == [0 if k is None else bisect_right(bounds, k) for k in keys]
    cuts = common.even_bounds(spark.range(100_000), F.col("id"), 1_000)
    assert len(cuts) == 999 and max(abs(c - 100 * (k + 1)) for k, c in enumerate(cuts)) <= 20
    assert common.even_bounds(spark.range(10), F.col("id"), 1) == []
    assert len(calls) < 100
