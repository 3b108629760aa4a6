"""Best-fit packing by exact complements: counts of lengths, indexes of their sums, then best fit for the rest.

A document longer than a sequence is cut into whole sequences and one shorter first piece. What counts for packing
is then how many pieces there are of each length, at most `length` numbers, so the plan is made from these alone and
has the same size for any number of documents: patterns of lengths, each with how often it is used.

Plan: lengths that are each other's complement are put together first. Then the longest length still there opens
sequences. Its gap is looked up in three indexes of what is available: a length that fills it, two lengths whose sum
does, then three. A combination is used as often as the counts allow, which uses up a length each time. Where none
fills the gap, best fit serves: the longest length that fits goes in, and the smaller gap is looked up again.

Pieces: each is numbered among those of its length by (task, place in the task), which the encoding writes beside the
ids; counts of tasks and lengths are added up, so nothing is sorted and no length or key is gathered in a task. The
number is found in its length's patterns by binary search.

Defined cases: a null text is empty and has the end id alone; an empty table gives no rows; repeated rows, null and
repeated doc_ids are packed row by row; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 1024
#: Of a combination, the longest piece is at least so much of the longest that fits: short pieces, which fill gaps
#: best, are not used up where long ones would do.
NEAR = 0.95
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("place", pa.int64())])
#: Texts of a written batch hold about so many bytes.
BATCH_BYTES = 2 << 20


def _encode(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, seen = tokens.ByteEncoder(path), TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            for part in tokens.slices(batch, "text", BATCH_BYTES):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), pc.fill_null(part.column("text"), "").to_pylist()):
                    ids = encoder.encode(text)
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        size = (n - start) % length or length
                        rows.append((doc_id, piece, start, size, ids[4 * start : 4 * (start + size)], task, seen[size]))
                        seen[size] += 1
                        start, piece = start + size, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), PIECES)], schema=PIECES)

    return run


class Available:
    """How many pieces are left of each length, and how many pairs of lengths there are for each sum."""

    def __init__(self, counts: dict[int, int], length: int):
        self.left = np.zeros(length + 1, dtype=np.int64)
        for size, n in counts.items():
            self.left[size] = n
        self.pairs = np.zeros(2 * length + 1, dtype=np.int64)
        there = np.flatnonzero(self.left)
        for size in there.tolist():
            others = there[there > size]
            self.pairs[size + others] += 1
            self.pairs[2 * size] += self.left[size] > 1

    def take(self, sizes: list[int], times: int) -> None:
        for size in set(sizes):
            before = int(self.left[size])
            after = before - times * sizes.count(size)
            self.left[size] = after
            if before > 1 >= after:
                self.pairs[2 * size] -= 1
            if before and not after:
                others = np.flatnonzero(self.left)
                self.pairs[size + others] -= 1

    def times(self, sizes: list[int]) -> int:
        """How often the sizes can be taken together."""
        return min(int(self.left[s]) // sizes.count(s) for s in set(sizes))

    def longest(self, gap: int, held: list[int]) -> Iterator[int]:
        """The lengths that fit the gap and can be taken with `held`, longest first."""
        for size in np.flatnonzero(self.left[: gap + 1])[::-1].tolist():
            if self.times([*held, size]):
                yield size

    def pair(self, total: int, most: int, held: list[int]) -> list[int] | None:
        """Two lengths of that sum, neither above `most`, longest first, that can be taken with `held`."""
        if total < 2 or not self.pairs[total]:
            return None
        high = np.arange((total + 1) // 2, min(most, total - 1) + 1)
        for a in high[(self.left[high] > 0) & (self.left[total - high] > 0)][::-1].tolist():
            if self.times([*held, a, total - a]):
                return [a, total - a]
        return None

    def exact(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three lengths that fill the gap and can be taken with `held`, the first of them a long one."""
        first = None
        for a in self.longest(gap, held):
            first = first or a
            if a == gap:
                return [a]
            if a < first * NEAR:
                break
            rest = gap - a
            if self.left[rest] and self.times([*held, a, rest]):
                return [a, rest]
            if found := self.pair(rest, a, [*held, a]):
                return [a, *found]
        return None


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences). Each pattern uses up a length or opens one, so they are few."""
    there, out = Available(counts, length), []

    def use(sizes: list[int]) -> None:
        out.append((sizes, there.times(sizes)))
        there.take(*out[-1])

    if there.left[length]:
        use([length])
    openers = range(length - 1, 0, -1)
    for opener in openers:
        sizes = [opener, length - opener]
        if there.left[opener] and there.left[length - opener] and there.times(sizes):
            use(sizes)
    for opener in openers:
        while there.left[opener]:
            sizes = [opener]
            while gap := length - sum(sizes):
                if rest := there.exact(gap, sizes):
                    sizes += rest
                    break
                best = next(there.longest(gap, sizes), None)
                if best is None:
                    break
                sizes.append(best)
            use(sizes)
    return out


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """For each length (length, first number of each of its places, sequence that one goes to, offset there)."""
    used, at, sequence = defaultdict(int), defaultdict(lambda: ([], [], [])), 0
    for sizes, times in patterns:
        offset = 0
        for size in sizes:
            first, where, offsets = at[size]
            first.append(used[size])
            where.append(sequence)
            offsets.append(offset)
            used[size] += times
            offset += size
        sequence += times
    return [(size, *lists) for size, lists in at.items()]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shape = "doc_id long, piece int, start long, length long, ids binary, task int, place long"
    pieces = common.written(rows.mapInArrow(_encode(tokenizer, length), shape), "pieces", compression="zstd")
    counts = common.written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    found = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `length` rows
    table = places(plan({r["length"]: r["n"] for r in found}, length))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    where = spark.createDataFrame(table, "length long, firsts array<long>, sequences array<long>, offsets array<long>")
    # The last of the length's places that begins at or before the number, by halving steps.
    most = max((len(t[1]) for t in table), default=1)
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])
    number = F.col("before") + F.col("place")
    numbered = pieces.join(common.small_enough(base), ["length", "task"]).join(F.broadcast(where), "length").withColumn("number", number)
    numbered = numbered.withColumn("at", F.aggregate(halves, F.lit(0), lambda p, s: F.when(F.get("firsts", p + s - 1) <= F.col("number"), p + s).otherwise(p)) - 1)
    sequence = F.get("sequences", "at") + F.col("number") - F.get("firsts", "at")
    return numbered.select("doc_id", "piece", "start", "length", "ids", sequence.alias("sequence_id"), F.get("offsets", "at").alias("offset"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
