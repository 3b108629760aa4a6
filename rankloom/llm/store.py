"""Content-addressed store of token ids.

Each document's ids (with an end id) are cut where a rolling hash over the ids says so, so equal
passages give equal chunks wherever they stand. Unique chunks are stored once; a recipe lists the
chunks of each document in ascending doc_id order; Merkle manifests over recipes verify both.

Files below `path`:
  raw/kind=1     digest, n_ids, ids (zstd of little-endian uint16 or uint32): unique chunks
  recipes        row (place in doc_id order), doc_id, start, n_tokens, root, digests, lengths
  manifest       level, block, hash: level 0 hashes runs of FAN recipe roots, level k runs of level k - 1

Null texts count as empty (their ids are the end id alone); an empty table gives empty files and an
empty result; repeated rows give a recipe each; ties of doc_id go by root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

WINDOW, AVERAGE, LEAST, MOST = 16, 512, 128, 4096
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FAN = 1024
#: Ids hashed at a time.
BLOCK = 1 << 16
SEEN = 200_000
DIGEST = 16


def powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Cutter:
    """Cuts id streams by content: a chunk ends where the hash of the last WINDOW ids has AVERAGE - 1 low bits clear."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, BLOCK + WINDOW), powers(INVERSE, BLOCK + WINDOW)

    def ends(self, ids: np.ndarray, at: np.ndarray) -> Iterator[list[int]]:
        """For each run ids[at[k] : at[k + 1]], where its chunks end, counted from its own start.

        Hashes are worked out in blocks over all runs: a window that reaches back into another run ends before LEAST ids of its own, where nothing is cut.
        """
        found = [np.zeros(0, np.int64)]
        for low in range(0, len(ids), BLOCK):
            before = min(low, WINDOW)
            own = ids[low - before : low + BLOCK].astype(np.uint64)
            sums = np.cumsum((own * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) * self.up[: len(own)])
            rolled = sums.copy()
            rolled[WINDOW:] -= sums[:-WINDOW]
            rolled *= self.down[: len(own)]
            found.append(np.flatnonzero((rolled[before:] >> np.uint64(40)) & np.uint64(AVERAGE - 1) == 0) + low + 1)
        hits = np.concatenate(found)
        begins, places = at[:-1], np.searchsorted(hits, at, "right").tolist()
        sizes = np.diff(at).tolist()
        for k, start in enumerate(begins.tolist()):
            size, out, last = sizes[k], [], 0
            for h in [*(hits[places[k] : places[k + 1]] - start).tolist(), size]:
                while h - last > MOST:
                    last += MOST
                    out.append(last)
                if h - last >= LEAST or h == size and h > last:
                    out.append(h)
                    last = h
            yield out


def digest_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=DIGEST).digest()


def root_of(digests: bytes) -> bytes:
    """Merkle root of a run of digests."""
    level = [digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)]
    while len(level) > 1:
        level = [digest_of(b"".join(level[k : k + 2])) for k in range(0, len(level), 2)]
    return level[0] if level else digest_of(b"")


RAW = "kind int, key binary, n_ids long, body binary, doc_id long, root binary, lengths binary"


def _encode(path: str, memo_pieces: int):
    """Rows of kind 0 (a recipe each: body holds the digests) and of kind 1 (chunks, once a task as far as it remembers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        encoder, cutter, seen, row = tokens.encoder_of(path, memo_pieces), Cutter(), set(), 0
        pack = zstandard.ZstdCompressor(level=3).compress
        schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("n_ids", pa.int64()), ("body", pa.binary()), ("doc_id", pa.int64()), ("root", pa.binary()), ("lengths", pa.binary())])
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                ids, at = encoder.encode(part.column("text"))
                raw, narrow, wide = memoryview(ids.tobytes()), memoryview(ids.astype("<u2").tobytes()), bool(ids.max(initial=0) > 0xFFFF)
                out, starts = [], at.tolist()
                for k, (doc_id, ends) in enumerate(zip(part.column("doc_id").to_pylist(), cutter.ends(ids, at))):
                    start, digests, lengths, last = starts[k], [], [], 0
                    for end in ends:
                        low, high = start + last, start + end
                        digests.append(digest := digest_of(raw[4 * low : 4 * high]))
                        lengths.append(end - last)
                        if digest not in seen:
                            if len(seen) < SEEN:
                                seen.add(digest)
                            broad = wide and bool(ids[low:high].max() > 0xFFFF)
                            out.append((1, digest, end - last, bytes([broad]) + pack(raw[4 * low : 4 * high] if broad else narrow[2 * low : 2 * high]), None, None, None))
                        last = end
                    row += 1
                    key = task.to_bytes(8, "big") + row.to_bytes(8, "big")
                    joined = b"".join(digests)
                    out.append((0, key, starts[k + 1] - start, joined, doc_id, root_of(joined), np.array(lengths, "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)] if out else [pa.array([], t.type) for t in schema], schema=schema)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, memo_pieces: int = 300_000) -> None:
    """Writes the ids of docs (doc_id, text) as a store below path."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, memo_pieces), RAW)
    # One shuffle carries chunks and recipes; a chunk that many texts hold arrives about once a task.
    rows.repartition("key").dropDuplicates(["kind", "key"]).write.partitionBy("kind").parquet(f"{path}/raw")
    whole = spark.read.schema(RAW).parquet(f"{path}/raw").where("kind = 0").select("doc_id", F.col("n_ids").alias("n_tokens"), "root", F.col("body").alias("digests"), "lengths", "key")
    placed = common.running_total(whole, F.col("doc_id"), [F.col("root"), F.col("key")], {"start": F.col("n_tokens"), "row": F.lit(1).cast("long")})
    files = max(1, min(placed.count() // 20_000, 4096))
    placed.select("row", "doc_id", "start", "n_tokens", "root", "digests", "lengths").repartitionByRange(files, "row").sortWithinPartitions("row").write.parquet(f"{path}/recipes")
    _manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _fold(rows: DataFrame, level: int) -> DataFrame:
    """Hashes runs of FAN rows (place, hash) in order; a run is at most FAN hashes."""
    run = F.expr(f"place div {FAN}")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda s: F.hex(s["hash"])), "")
    return rows.groupBy(run.alias("place")).agg(F.unhex(F.sha2(joined, 256)).alias("hash")).select(F.lit(level).alias("level"), "place", "hash")


def _manifest(recipes: DataFrame) -> DataFrame:
    rows = recipes.select(F.col("row").alias("place"), F.col("root").alias("hash"))
    n, level = rows.count(), 0
    out = None
    while n:
        folded = common.written(_fold(rows, level), "manifest")
        out = folded if out is None else out.unionByName(folded)
        rows, n, level = folded, (n - 1) // FAN + 1 if n > 1 else 0, level + 1
        if n == 1:
            break
    empty = recipes.sparkSession.createDataFrame([], "level int, place long, hash binary")
    return empty if out is None else out


#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC polynomial, bit-reflected."""
    out, b = np.zeros_like(a), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), b >> np.uint32(1))
    return out


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 values moved before `zeros` further bytes; the CRC of a whole is the xor of its parts' moved ones."""
    out, zeros, power = crc.astype(np.uint32), zeros.astype(np.int64), np.array([1 << 23], np.uint32)  # x to the 8th
    while zeros.any():
        out = np.where(zeros & 1, _times(out, np.broadcast_to(power, out.shape)), out).astype(np.uint32)
        power, zeros = _times(power, power), zeros >> 1
    return out


def unpack(body: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body[1:])
    return np.frombuffer(raw, "<u4" if body[0] else "<u2").astype("<u4")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads chunks back: their digest as computed from the ids, and the ids' CRC."""
    import zlib

    for batch in batches:
        crcs = []
        for key, n, body in zip(*(batch.column(c).to_pylist() for c in ("key", "n_ids", "body"))):
            raw = unpack(body).tobytes()
            if digest_of(raw) != key or len(raw) != 4 * n:
                raise ValueError(f"chunk {key.hex()} does not hold what its name says")
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crcs, pa.int64())], names=["digest", "crc"])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the bytes that follow it in its document."""
    for batch in batches:
        rows, digests, after = [], [], []
        for row, root, keys, lengths in zip(*(batch.column(c).to_pylist() for c in ("row", "root", "digests", "lengths"))):
            if root_of(keys) != root:
                raise ValueError(f"recipe {row} does not match its root")
            left = np.frombuffer(lengths, "<u4").astype(np.int64)
            after.append(4 * (left.sum() - np.cumsum(left)))
            rows += [row] * len(left)
            digests += [keys[k : k + DIGEST] for k in range(0, len(keys), DIGEST)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.binary()), pa.array(np.concatenate(after) if after else [], pa.int64())], names=["row", "digest", "after"])


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = (np.asarray(batch.column(c), dtype=np.int64) for c in ("crc", "after"))
        moved = crc_shift(crc.astype(np.uint32), after).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(moved)], names=["row", "crc"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store: doc_id, start, n_tokens, ids_crc32, from its chunks and recipes.

    Every chunk is hashed again and every root recomputed (a mismatch raises); the manifest is folded anew
    and compared. CRCs of chunks are combined into those of documents, so ids need no shuffle.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    kept, anew = (x.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(level, place, hash))").alias("h")).first() for x in (spark.read.parquet(f"{path}/manifest"), _manifest(recipes)))
    if kept != anew:
        raise ValueError("the recipes do not match the manifest")
    chunks = spark.read.schema(RAW).parquet(f"{path}/raw").where("kind = 1").select("key", "n_ids", "body").mapInArrow(_scan, "digest binary, crc long")
    listed = recipes.select("row", "root", "digests", "lengths").mapInArrow(_list, "row long, digest binary, after long")
    moved = listed.join(chunks, "digest", "left").withColumn("crc", F.coalesce("crc", F.raise_error(F.lit("a chunk of a recipe is missing")).cast("long")))
    crcs = moved.select("row", "crc", "after").mapInArrow(_move, "row long, crc long").groupBy("row").agg(F.expr("bit_xor(crc)").alias("ids_crc32"))
    return recipes.select("row", "doc_id", "start", "n_tokens").join(crcs, "row").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The whole ids of some documents: doc_id, row, ids (array), rebuilt from their chunks."""
    recipes = spark.read.parquet(f"{path}/recipes").where(F.col("doc_id").isin(doc_ids))
    listed = recipes.select("row", "root", "digests", "lengths").mapInArrow(_list, "row long, digest binary, after long")
    chunks = spark.read.schema(RAW).parquet(f"{path}/raw").where("kind = 1").select(F.col("key").alias("digest"), "body")
    ids = F.udf(lambda parts: [int(x) for body in parts for x in unpack(body)], "array<long>")
    per = listed.join(chunks, "digest").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("after"), "body"))), lambda s: s["body"]).alias("parts"))
    return recipes.select("doc_id", "row").join(per, "row").select("doc_id", "row", ids("parts").alias("ids"))


def op10_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, stored and read back."""
    import public_tokenizers

    path = common.new_path(spark, "store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, path)
