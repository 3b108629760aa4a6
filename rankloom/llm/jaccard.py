"""Near-duplicate documents by an n-gram Jaccard join.

A document's set holds the hashes of its distinct 5-word shingles. Documents of equal sets are one class.
Shingles are ordered rare first, by a table of counts over CELLS hash cells (a fixed size) and the hash; two
sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of each, so only these are
shuffled. The documents of one such shingle form a bucket.

Buckets never emit all their pairs. First every bucket pairs its members with its leader only: the one in
which the shingle stands first, so with the fewest rarer ones, which the original of a group of copies has.
Pairs are verified once on whole sets, and what is linked is contracted. Of buckets that still hold several
components, those with the same members are one. They pair with other leaders while many pairs across
components would pass the length and positional filters and that shrinks them; then these pairs are all that
is left. Members of a bucket are sorted by size to find them, and buckets of more than BLOCK members are cut
into pairs of blocks. No candidate is dropped unless a filter proves it below the threshold.

Pairs are verified by unit: a unit holds neighbourhoods of the graph of candidate pairs, or a pair of blocks
of a large one, so each set is sent to its unit once however many pairs it has there.

Buckets expected to be large are dealt out over several tasks (salts) from the table of counts. Defined
cases: texts without words, and null texts, link with nothing and have no shingles; with fewer than five
words the whole sequence is the one shingle; equal rows are near-duplicates of each other; rows without a
doc_id take part, and a group of nothing else has a null component_id; an empty table gives no rows; other
columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

WORDS = 5
#: The threshold as a fraction; a pair links when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
CELL_BITS = 20
CELLS, CHUNK = 1 << CELL_BITS, 4096
SALT_ROWS = 4096
#: Members of a bucket, and shingles of a unit, that one task holds at a time.
BLOCK, UNIT_SHINGLES = 2048, 250_000
#: Links from a pair within which a common label is looked for, so that its sets are sent once.
NEAR = 3
#: Pairs sent on at a time.
PAIRS = 1 << 20
#: Buckets get another leader while more than so many pairs a member pass the filters, and a round takes off a quarter at least.
SPREAD = 4
SEEN = 200_000
FILTER_BITS = 1 << 23
SHIFT = 24  # a posting holds the set's size and the shingle's place in one long


#: The shingle's place, from a posting.
PLACE = f"np & {(1 << SHIFT) - 1}L"


class Shingler:
    """Sorted sets of shingle hashes of batches of texts."""

    def __init__(self, seed: int):
        self.seed = seed

    def _hash(self, words: pa.Array) -> np.ndarray:
        import xxhash

        digest, seed = xxhash.xxh64_intdigest, self.seed
        return np.fromiter((digest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))
        for space in "\t\n\v\f\r":
            texts = pc.replace_substring(texts, space, " ")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        real = np.asarray(pc.not_equal(coded.dictionary, ""))[codes] if len(codes) else np.zeros(0, bool)
        words = self._hash(coded.dictionary)[codes[real]] if len(codes) else np.zeros(0, np.uint64)
        ends = np.concatenate(([0], np.cumsum(real)))[at - at[0]]
        mixed = self._mix(words, WORDS)
        out = []
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if end - start >= WORDS:
                out.append(np.unique(mixed[start : end - WORDS + 1]))
            else:
                out.append(self._mix(words[start:end], end - start))
        return out

    @staticmethod
    def _mix(words: np.ndarray, width: int) -> np.ndarray:
        n = len(words) - width + 1
        if width <= 0 or n <= 0:
            return np.zeros(0, np.uint64)
        x = np.full(n, width, np.uint64)
        for k in range(width):
            x = (x ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        return x


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    import hashlib

    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def cell_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix(shingles: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles in order of their cell's count, then of hash."""
    n = len(shingles)
    size = n - -(-NUM * n // DEN) + 1
    count = cells[cell_of(shingles)]
    return shingles[np.lexsort((shingles, count))[:size]]


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


META = "kind int, doc_id long, n long, k long, k2 long, counts binary"


def _meta(seed: int):
    """Rows (kind 0: doc_id, n, k, k2) and counts (kind 1: number of a chunk of cells in doc_id, its counts, of sets that the task has not seen before)."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("k2", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, seen = Shingler(seed), np.zeros(CELLS, np.int64), set()
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                rows, fresh = [], []
                for doc_id, own in zip(part.column("doc_id").to_pylist(), shingler.sets(part.column("text"))):
                    k = identity(own)
                    rows.append((0, doc_id, len(own), *k, None))
                    if k not in seen:
                        if len(seen) < SEEN:
                            seen.add(k)
                        fresh.append(own)
                if fresh:
                    counts += np.bincount(cell_of(np.concatenate(fresh)), minlength=CELLS)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        rows = [(1, c, None, None, None, own) for c, own in chunks(counts)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def chunks(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """Numbers and compressed bytes of the chunks that hold a count: a small task's are mostly zeros."""
    whole = counts.reshape(-1, CHUNK)
    return [(int(c), zlib.compress(whole[c].astype("<i8").tobytes(), 1)) for c in np.flatnonzero(whole.any(axis=1))]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk with the sum of its counts in this task."""
    counts = np.zeros((CELLS // CHUNK, CHUNK), np.int64)
    for batch in batches:
        for c, own in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            counts[c] += np.frombuffer(zlib.decompress(own.as_buffer()), "<i8")
    rows = chunks(counts.reshape(-1))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["chunk", "counts"])


def _postings(seed: int, shared):
    """(h, salt, size and place, k) of every shingle in the prefix of every set, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(shared.value, np.int64)
        mean = float(np.median(cells))
        salts = 1 + (np.maximum(0, cells - (mean + 6 * np.sqrt(mean + 1))) // SALT_ROWS).astype(np.int64)
        shingler, seen = Shingler(seed), set()
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                hs, ks, nps = [], [], []
                for own in shingler.sets(part.column("text")):
                    if not len(own):
                        continue
                    k = identity(own)
                    if k in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(k)
                    first = prefix(own, cells)
                    hs.append(first)
                    ks.append(np.full(len(first), k[0], np.int64))
                    if len(own) >> SHIFT:
                        raise ValueError(f"a text has {len(own)} shingles, more than a posting can count")
                    nps.append((len(own) << SHIFT) + np.arange(len(first), dtype=np.int64))
                if hs:
                    h, k = np.concatenate(hs), np.concatenate(ks)
                    wide = salts[cell_of(h)]
                    salt = np.where(wide > 1, (k & np.int64(0x7FFFFFFF)) % wide, -1)
                    yield pa.RecordBatch.from_arrays([_long(h), pa.array(salt), pa.array(np.concatenate(nps)), pa.array(k)], names=["h", "salt", "np", "k"])

    return run


def can_reach(np_a: np.ndarray, np_b: np.ndarray) -> np.ndarray:
    """Length and positional filter, as if the shingle at hand were the first that both sets have in common."""
    a, b, mask = np_a >> SHIFT, np_b >> SHIFT, (1 << SHIFT) - 1
    overlap = 1 + np.minimum(a - (np_a & mask), b - (np_b & mask)) - 1
    return (DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)) & ((NUM + DEN) * overlap >= NUM * (a + b))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by bucket: pairs of the first member with each other one (kind 0: a, b), and the rows of buckets with more than two members (kind 1: h, k, np)."""
    names, held = ["h", "salt", "np", "k"], None

    def work(rows: list[np.ndarray]) -> pa.RecordBatch:
        h, salt, place, k = rows
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])))
        # Several tasks may have sent the same set.
        once = np.concatenate(([True], (k[1:] != k[:-1]))) | new
        h, salt, place, k, new = h[once], salt[once], place[once], k[once], new[once]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        lead = np.repeat(start, size)
        many = np.repeat(size > 1, size)
        pair = many & ~new
        pair[pair] = can_reach(place[lead[pair]], place[pair])
        a, b = np.minimum(k[lead[pair]], k[pair]), np.maximum(k[lead[pair]], k[pair])
        # Two members are compared by their star already; more, or those of a salted bucket, may be open later.
        keep = np.repeat(size > 2, size) | (salt >= 0)
        kind = np.concatenate((np.zeros(len(a), np.int32), np.ones(int(keep.sum()), np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(np.concatenate((a, h[keep]))), pa.array(np.concatenate((b, k[keep]))), pa.array(np.concatenate((np.full(len(a), -1), place[keep]))), pa.array(np.concatenate((np.zeros(len(a), bool), salt[keep] >= 0)))],
            names=["kind", "a", "b", "np", "salted"],
        )

    for batch in batches:
        rows = [np.asarray(batch.column(c)) for c in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        cut = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1 if (rows[0][0], rows[1][0]) != (rows[0][-1], rows[1][-1]) else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield work([r[:cut] for r in rows])
    if held is not None and len(held[0]):
        yield work(held)


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs _across would send, not yet made distinct."""
    many = sum(len(i) for rows in _whole(batches) for i, _ in _partners(rows))
    yield pa.RecordBatch.from_arrays([pa.array([many], pa.int64())], names=["pairs"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different components that can reach the threshold, from open buckets sorted by unit (h, p, q) and size."""

    def distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], names=["a", "b"])

    for rows in _whole(batches):
        k, found, many = rows[-1], [], 0
        for i, j in _partners(rows):
            found.append((k[i], k[j]))
            many += len(i)
            if many > PAIRS:
                yield distinct(found)
                found, many = [], 0
        if found:
            yield distinct(found)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut where a unit ends."""
    held = None
    for batch in batches:
        rows = [np.asarray(batch.column(c)) for c in ("h", "p", "q", "side", "np", "comp", "k")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield [r[:cut] for r in rows]
    if held is not None and len(held[0]):
        yield held


def _partners(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within units that are of different components and pass the length and positional filters."""
    h, p, q, side, place, comp, _ = rows
    start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
    end = np.repeat(np.append(start[1:], len(h)), np.diff(np.append(start, len(h))))
    at, size = np.arange(len(h)), place >> SHIFT
    for step in range(1, len(h)):
        at = at[end[at] - at > step]
        # Sizes rise, so who is too small for this partner is too small for those that follow.
        at = at[DEN * size[at] >= NUM * size[at + step]]
        if not len(at):
            break
        i = at[(comp[at] != comp[at + step]) & ((side[at] == 2) | (side[at] != side[at + step]))]
        i = i[can_reach(place[i], place[i + step])]
        yield i, i + step


def _bodies(seed: int, shared):
    """(doc_id, k, body) of documents whose doc_id is in the shared filter, once a task; a body holds the sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        shingler, seen = Shingler(seed), set()
        for batch in batches:
            mark = np.asarray(batch.column("mark"))
            batch = batch.filter(pa.array((bits[mark >> 3] >> (mark & 7).astype(np.uint8) & 1).astype(bool)))
            for part in tokens.slices(batch, "text"):
                rows = []
                for doc_id, own in zip(part.column("doc_id").to_pylist(), shingler.sets(part.column("text"))):
                    k = identity(own)[0]
                    if (doc_id, k) not in seen:
                        if len(seen) < SEEN:
                            seen.add((doc_id, k))
                        rows.append((doc_id, k, own.tobytes()))
                if rows:
                    ids, ks, bodies = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "k", "body"])

    return run


RANGES = (np.arange(1, 16, dtype=np.uint64)) << np.uint64(60)


def reaches(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link. Counts by hash range bound the overlap first (suffix filter)."""
    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    need = NUM * (len(a) + len(b))
    by = [np.diff(np.concatenate(([0], np.searchsorted(x, RANGES), [len(x)]))) for x in (a, b)]
    if (NUM + DEN) * int(np.minimum(*by).sum()) < need:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return (NUM + DEN) * int((both[1:] == both[:-1]).sum()) >= need


def _verify(bodies: pa.Table, pairs: pa.Table) -> pa.Table:
    """The pairs of a unit that link."""
    sets = {k: np.frombuffer(body.as_buffer(), np.uint64) for k, body in zip(bodies.column("k").to_pylist(), bodies.column("body"))}
    a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
    good = pa.array([reaches(sets[x], sets[y]) for x, y in zip(a, b)], pa.bool_())
    return pairs.select(["a", "b"]).filter(good)


class Join:
    """One run of the join over docs (doc_id, text); tables are written to the shared folder on the way."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        for self.seed in range(1, 9):
            self.path = common.new_path(self.spark, "sets")
            self.docs.mapInArrow(_meta(self.seed), META).write.partitionBy("kind").parquet(self.path)
            rows = self.spark.read.schema(META).parquet(self.path)
            self.meta = rows.where("kind = 0").select("doc_id", "n", "k", "k2")
            self.counts = rows.where("kind = 1").select(F.col("doc_id").alias("chunk"), "counts").mapInArrow(_added, "chunk long, counts binary")
            # A class is known by one long; two different sets with the same one call for another seed.
            self.classes = common.written(self.meta.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("k2").alias("low"), F.max("k2").alias("high")), "classes")
            if not self.classes.where("low <> high").head(1):
                break
        else:
            raise RuntimeError("different sets have one hash by every seed")

    def buckets(self) -> tuple[DataFrame, DataFrame]:
        """(a, b) distinct star pairs, and (h, k, np, salted) rows of buckets with more than two members."""
        cells = np.zeros((CELLS // CHUNK, CHUNK), np.int64)
        for r in self.counts.repartition("chunk").mapInArrow(_added, "chunk long, counts binary").collect():  # one row for each of CELLS / CHUNK chunks
            cells[r["chunk"]] += np.frombuffer(zlib.decompress(r["counts"]), "<i8")
        shared = self.spark.sparkContext.broadcast(cells.tobytes())
        posted = self.docs.select("text").mapInArrow(_postings(self.seed, shared), "h long, salt long, np long, k long")
        schema = "kind int, a long, b long, np long, salted boolean"
        path = common.new_path(self.spark, "buckets")
        posted.repartition("h", "salt").sortWithinPartitions("h", "salt", F.expr(PLACE), "k").mapInArrow(_stars, schema).write.partitionBy("kind").parquet(path)
        rows = self.spark.read.schema(schema).parquet(path)
        pairs = common.written(rows.where("kind = 0").select("a", "b").distinct(), "pairs")
        return pairs, rows.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("k"), "np", "salted")

    def units(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, unit). Pairs stand by the smallest member within NEAR links of them; these groups are gathered up to UNIT_SHINGLES, or cut into pairs of blocks."""
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        label = both.groupBy("a").agg(F.least("a", F.min("b")).alias("near"))
        for _ in range(NEAR - 1):
            label = both.join(label.select(F.col("a").alias("b"), "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        label = common.small_enough(common.written(label, "near"))
        at = pairs.join(label, "a").join(label.select(F.col("a").alias("b"), F.col("near").alias("near_b")), "b")
        at = common.written(at.select("a", "b", F.least("near", "near_b").alias("near")), "near")
        member = at.select("near", F.col("a").alias("k")).union(at.select("near", "b")).distinct()
        size = member.join(self.classes.select("k", "n"), "k").groupBy("near").agg(F.sum("n").alias("n"))
        size = common.written(size.withColumn("blocks", F.expr(f"cast(ceil(n / {UNIT_SHINGLES}) as int)")), "sizes")
        small = max(1, (size.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // UNIT_SHINGLES)
        p, q = (F.pmod(F.xxhash64(c), F.col("blocks")) for c in ("a", "b"))
        unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("near"), F.lit(small))).otherwise(F.xxhash64("near", F.least(p, q), F.greatest(p, q)))
        return at.join(common.small_enough(size.select("near", "blocks")), "near").select("a", "b", unit.alias("unit"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link; a filter of fixed size keeps the texts of most other documents out."""
        placed = common.written(self.units(pairs), "units")
        need = placed.select("unit", F.col("a").alias("k")).union(placed.select("unit", "b")).distinct()
        need = common.written(need.join(self.classes.select("k", "doc_id"), "k").select("unit", F.col("k").alias("own_k"), F.col("doc_id").alias("own_id")), "needed")
        mark = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
        words = need.select(mark("own_id").alias("m")).groupBy(F.expr("m div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(m % 32 as int)))").alias("v")).collect()  # FILTER_BITS / 32 rows at most
        table = np.zeros(FILTER_BITS // 32, np.uint32)
        for r in words:
            table[r["w"]] = r["v"]
        shared = self.spark.sparkContext.broadcast(table.astype("<u4").tobytes())
        found = self.docs.select("doc_id", "text", mark("doc_id").cast("long").alias("mark")).mapInArrow(_bodies(self.seed, shared), "doc_id long, k long, body binary")
        sent = found.join(common.small_enough(need), (F.col("k") == F.col("own_k")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("unit", "k", "body")
        out = common.written(sent.groupBy("unit").cogroup(placed.groupBy("unit")).applyInArrow(_verify, "a long, b long"), "links")
        common.drop(placed)
        common.drop(need)
        return out

    def open_buckets(self, rows: DataFrame, comps: DataFrame) -> tuple[DataFrame, int]:
        """Rows (h, k, np, comp, m) of buckets that still hold several components, and how many rows.

        Of buckets with the same members only the first in the order of shingles stays: it is the first of these
        shingles that any two members have in common.
        """
        known = common.small_enough(comps.select(F.col("node").alias("k"), "component"))
        own = rows.select("h", "k", "np").join(known, "k", "left").withColumn("comp", F.coalesce("component", "k")).drop("component")
        marks = [F.expr(f"bit_xor(xxhash64(k, {i}))").alias(f"x{i}") for i in (1, 2)]
        whole = own.groupBy("h").agg(F.count(F.lit(1)).alias("m"), *marks, F.min(F.struct("k", "np")).alias("first"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        once = whole.where("low <> high").groupBy("m", "x1", "x2").agg(F.min(F.struct("first.np", "h")).alias("one"))
        alive = common.written(once.select("one.h", "m"), "alive")
        members = alive.agg(F.sum("m")).first()[0] or 0
        return common.written(own.join(common.small_enough(alive), "h"), "open"), members

    def led(self, rows: DataFrame, turn: int) -> DataFrame:
        """Distinct pairs of each open bucket's leader of this turn, the first of a component, with its members of other components."""
        lead = rows.groupBy("h").agg(F.min(F.struct(F.xxhash64("comp", F.lit(turn)).alias("o"), F.expr(PLACE).alias("place"), "k", "np", "comp")).alias("lead"))
        size = lambda c: F.shiftright(c, SHIFT)
        left = lambda c: size(c) - F.col(c).bitwiseAND(F.lit((1 << SHIFT) - 1).cast("long"))
        both = rows.join(lead, "h").where("comp <> lead.comp").select("k", "np", F.col("lead.k").alias("lead_k"), F.col("lead.np").alias("lead_np"))
        fits = DEN * F.least(size("np"), size("lead_np")) >= NUM * F.greatest(size("np"), size("lead_np"))
        reach = (NUM + DEN) * F.least(left("np"), left("lead_np")) >= NUM * (size("np") + size("lead_np"))
        return both.where(fits & reach).select(F.least("k", "lead_k").alias("a"), F.greatest("k", "lead_k").alias("b")).distinct()

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows of open buckets by unit: a bucket, or a pair of blocks of it."""
        at = rows.withColumn("blocks", F.expr(f"cast(ceil(m / {BLOCK}) as int)")).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
        meets = F.expr("transform(sequence(0, blocks - 1), q -> named_struct('p', least(block, q), 'q', greatest(block, q), 'side', if(q = block, 2, if(block < q, 0, 1))))")
        dealt = at.withColumn("meet", F.explode(meets)).select("h", "meet.p", "meet.q", "meet.side", "np", "comp", "k")
        return dealt.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q", "np", "k")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        pairs, rows = self.buckets()
        links = self.verified(pairs)
        before, turn, comps = None, 0, common.written(common.components(links), "components")
        while True:
            rows, members = self.open_buckets(rows, comps)
            if not members:
                break
            passing = self.dealt(rows).mapInArrow(_passing, "pairs long").agg(F.sum("pairs")).first()[0] or 0
            last = passing <= SPREAD * members or (before is not None and 4 * passing > 3 * before)
            more = self.dealt(rows).mapInArrow(_across, "a long, b long").distinct() if last else self.led(rows, turn := turn + 1)
            more = common.written(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
            links = self.verified(more).union(comps.where("node <> component").select("node", "component"))
            pairs, before, comps = pairs.unionByName(more), passing, common.written(common.components(links), "components")
            if last:
                break
        labelled = self.classes.join(comps.select(F.col("node").alias("k"), "component"), "k", "left").select("k", "doc_id", F.coalesce("component", "k").alias("c"))
        least = labelled.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        labels = common.written(labelled.join(least, "c").select(F.col("k").alias("_k"), "component_id"), "labels")
        out = self.meta.join(labels, (F.col("k") == F.col("_k")) & (F.col("n") > 0), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    return Join(docs).run()


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
