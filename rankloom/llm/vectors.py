"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are scaled to length 1, padded with zeros to a power of two and turned by random rotations. Stored for
each, once: the signs after the first rotation as packed bits (its code), the correction factor (the inner
product of the code's own unit vector with the vector), the rotated components rounded to bytes with their
step, and the signs of all rotations as bands. Bytes of one vector with code and factor of another give an
unbiased estimate of their inner product, with an error bound of known confidence; vectors themselves are
fetched only for members of a block with a pair whose bound reaches the threshold, and decide there in full.

Vectors with equal components are one class from the start, named by a hash (another seed is taken if two
classes clash). Candidates share a band of code bits; bands are as long as the number of classes asks for. A
band's bucket is cut into blocks of about BLOCK classes and pairs of blocks are compared as whole matrices,
so a bucket of any size is spread over many tasks. A pair is counted in the first band in which both classes
agree. Of pairs found only counts and a spanning forest leave a task; links between classes that differ are
never dropped.

Defined cases: vectors that are null, of length 0, or that hold null or non-finite components link with
nothing; vectors of different dimension are compared within their dimension; repeated rows are vectors of
their own, also under one vec_id; an empty table gives no rows; other columns are ignored. A pair at the
threshold itself shares no band with probability MISS (see band_plan), nearer ones with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 1024
MISS = 1e-4
#: Width of the error bound in standard deviations: a pair is wrongly passed over once in about 30,000.
EPSILON = 4.0
SEED = 5


def rotation(dim: int, turn: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, turn]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_plan(classes: int, threshold: float, miss: float = MISS, per_bucket: float = 512.0) -> tuple[int, int]:
    """(bits of a band, number of bands) so that random vectors share a bucket with few others and a pair at the threshold is missed with probability `miss`."""
    agree = 1 - acos(min(1.0, threshold)) / pi
    bits = max(6, ceil(log2(max(classes, 2) / per_bucket)))
    return bits, max(1, ceil(log(miss) / log(1 - agree**bits)))


class Codes:
    """Codes, factors, rounded components and sign bits of the rows of x."""

    def __init__(self, x: np.ndarray, bits: int = 0):
        width = 1 << max(0, (x.shape[1] - 1).bit_length())
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        turned = x @ rotation(width, 0)
        self.code = np.packbits(turned > 0, axis=1)
        self.factor = np.abs(turned).sum(axis=1) / np.sqrt(width)
        self.step = np.maximum(np.abs(turned).max(axis=1), 1e-12) / 127
        self.level = np.rint(turned / self.step[:, None]).astype(np.int8)
        signs = [turned > 0]
        while len(signs) * width < bits:
            signs.append(x @ rotation(width, len(signs)) > 0)
        self.signs = np.concatenate(signs, axis=1)[:, :bits]


def estimate(level: np.ndarray, step: np.ndarray, code: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of rounded vectors with coded ones, and the half widths of their bounds."""
    width = level.shape[1]
    signs = np.unpackbits(code, axis=1, count=width).astype(np.float32) * 2 - 1
    factor = np.maximum(factor, 1e-9).astype(np.float32)
    guess = (level.astype(np.float32) * step[:, None].astype(np.float32)) @ signs.T / (np.sqrt(np.float32(width)) * factor)
    spread = np.sqrt(np.maximum(1 - factor**2, 0) / max(width - 1, 1))
    return guess, EPSILON * (spread[None, :] + step[:, None].astype(np.float32) / np.sqrt(12)) / factor[None, :]


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _rows(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


CODED = "class_id long, dim int, buckets array<long>, code binary, factor double, step double, level binary, body binary"


def _encode(bits: int, bands: int):
    """One row for each class with all that is stored for it; body holds the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("unit")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            start = np.concatenate(([0], np.cumsum(at)))[:-1]
            ids = np.asarray(batch.column("class_id"))
            for dim in np.unique(at).tolist():
                own = np.flatnonzero(at == dim)
                x = flat[start[own][:, None] + np.arange(dim)[None, :]]
                c = Codes(x, bits * bands)
                buckets = c.signs.reshape(len(own), bands, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, bands), pa.int32()), pa.array(buckets.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(np.full(len(own), dim, np.int32)), listed, _bytes(c.code), pa.array(c.factor), pa.array(c.step), _bytes(c.level), _bytes(x)],
                    names=[x.split()[0] for x in CODED.split(", ")],
                )

    return run


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = np.asarray(table.column("side"))
    same = bool((side == 2).all())
    return (np.arange(len(side)),) * 2 + (same,) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1), same)


UNIT = ["dim", "band", "bucket", "p", "q"]


def _promising(threshold: float):
    """Members of a unit with at least one pair whose bound reaches the threshold."""

    def run(table: pa.Table) -> pa.Table:
        a, b, same = _sides(table)
        hit = np.zeros(table.num_rows, bool)
        if len(a) and len(b):
            step, factor = np.asarray(table.column("step")), np.asarray(table.column("factor"))
            guess, width = estimate(_rows(table.column("level"), np.int8)[a], step[a], _rows(table.column("code"), np.uint8)[b], factor[b])
            near = guess + width >= threshold
            if same:
                np.fill_diagonal(near, False)
                near |= near.T
            hit[a] |= near.any(axis=1)
            hit[b] |= near.any(axis=0)
        return table.select([*UNIT, "side", "class_id"]).filter(pa.array(hit))

    return run


def _compare(threshold: float):
    """Counts and links of one unit: rows (class_id, links, partner)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band = key[1].as_py()
        table = table.sort_by("class_id")
        a, b, same = _sides(table)
        unit = _rows(table.column("body"), np.float64)
        ids, size = np.asarray(table.column("class_id")), np.asarray(table.column("copies"))
        near = unit[a] @ unit[b].T >= threshold - 1e-9
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        parts = range(0, len(i), 65536)
        if len(i):
            found = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 65536]], unit[j[k : k + 65536]]) for k in parts]) >= threshold
            if band:  # else it was counted in an earlier band
                earlier = np.array(table.column("buckets").to_pylist(), dtype=np.int64)[:, :band]
                found &= np.concatenate([~(earlier[i[k : k + 65536]] == earlier[j[k : k + 65536]]).any(axis=1) for k in parts])
            i, j = i[found], j[found]
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        # A spanning forest of the unit's links: all that the components need of them.
        root = np.arange(len(ids))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        pairs = []
        for p, q in zip(i.tolist(), j.tolist()):
            s, t = find(p), find(q)
            if s != t:
                root[max(s, t)] = min(s, t)
                pairs.append((int(ids[p]), int(ids[q])))
        held = np.flatnonzero(links)
        first = [p for p, _ in pairs] + ids[held].tolist()
        count = [0] * len(pairs) + links[held].tolist()
        other = [q for _, q in pairs] + [None] * len(held)
        return pa.table({"class_id": pa.array(first, pa.int64()), "links": pa.array(count, pa.int64()), "partner": pa.array(other, pa.int64())})

    return run


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, class_id; null where it links with nothing) and (class_id, copies, unit) of rows (vec_id, embedding)."""
    raw = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    high = F.array_max(F.transform("v", lambda x: F.abs(x)))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (high > 0), F.lit(False))
    # Divided by the largest component first, so that squares neither overflow nor vanish.
    raw = raw.withColumn("ok", good).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x / high)))
    raw = raw.withColumn("unit", F.when(F.col("ok"), F.transform("v", lambda x: x / norm + 0.0)))
    for seed in range(1, 9):
        named = common.written(raw.select("vec_id", "unit", F.when(F.col("unit").isNotNull(), F.xxhash64("unit", F.lit(seed))).alias("class_id")), "units")
        per = named.where("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"), F.min(F.xxhash64("unit", F.lit(0))).alias("low"), F.max(F.xxhash64("unit", F.lit(0))).alias("high"), F.first("unit").alias("unit"))
        per = common.written(per, "classes")
        if not per.where("low <> high").head(1):
            break
    else:
        raise RuntimeError("different vectors have one hash by every seed")
    return named.select("vec_id", "class_id"), per.select("class_id", "copies", "unit")


def near_vectors(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of rows (vec_id, embedding array)."""
    member, classes = classes_of(rows)
    bits, bands = band_plan(classes.count(), threshold)
    coded = common.written(classes.select("class_id", "unit").mapInArrow(_encode(bits, bands), CODED), "codes")
    banded = coded.select("class_id", "dim", F.posexplode("buckets").alias("band", "bucket"))
    load = banded.groupBy("dim", "band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    load = common.small_enough(common.written(load.select("dim", "band", "bucket", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("blocks")), "load"))
    at = banded.join(load, ["dim", "band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    # Block p meets itself (side 2) and every other block q: of p < q, p is side 0 and q side 1.
    meets = F.expr("transform(sequence(0, blocks - 1), q -> named_struct('p', least(block, q), 'q', greatest(block, q), 'side', if(q = block, 2, if(block < q, 0, 1))))")
    dealt = at.withColumn("meet", F.explode(meets)).select("class_id", "dim", "band", "bucket", "meet.p", "meet.q", "meet.side")
    sent = dealt.join(coded.select("class_id", "code", "factor", "step", "level"), "class_id")
    schema = "dim int, band int, bucket long, p int, q int, side int, class_id long"
    hits = common.written(sent.groupBy(*UNIT).applyInArrow(_promising(threshold), schema), "promising")
    full = hits.join(coded.select("class_id", "body", "buckets").join(classes.select("class_id", "copies"), "class_id"), "class_id")
    found = common.written(full.groupBy(*UNIT).applyInArrow(_compare(threshold), "class_id long, links long, partner long"), "found")
    links = found.where("partner is not null").select(F.col("class_id").alias("a"), F.col("partner").alias("b"))
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    labels = common.components(links).select(F.col("node").alias("class_id"), "component")
    known = classes.select("class_id", "copies").join(counts, "class_id", "left").join(labels, "class_id", "left")
    known = known.select("class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    known = common.written(known, "labels")
    least = member.where("class_id is not null").groupBy("class_id").agg(F.min("vec_id").alias("least")).join(known, "class_id").groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(F.col("class_id").alias("_class"), "n_links", "component_id")
    out = member.join(known, F.col("class_id") == F.col("_class"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
