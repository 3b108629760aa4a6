"""Mixture-controlled packing by deficit round-robin, one round a sequence.

Each source is a queue of its documents in doc_id order. In every round, which is one sequence long, a source
earns a quantum of tokens in proportion to its target and serves just that, cutting a document at the quantum's
edge; fractions of a token are its deficit, carried to the next round. So what a source has served by the end
of a round is a function of that round alone: floor(share * round tokens + a fixed fraction), up to its queue's
end. Sources that have run out leave their part to the others: a round then covers more of the shares' clock
(see clock). All rounds are worked out at once, and the stream is cut at every multiple of the sequence length:
all sequences but the last are full.

Each sequence holds, of each source, its share within two quantum steps and what rounding moves over the
sequence's edges (less than a step for each source). A step is one token, or length / 64 tokens for sources whose
whole share of a sequence is less than that, as their documents would otherwise be cut into single tokens.

Defined cases: null texts are documents of the end id alone; a null source is a source of its own; an
empty table gives no pieces; repeated rows are packed as often as they occur; ties of doc_id go by the
hash of the ids; other columns are ignored. Without targets the sources' own token shares are used. A source of
share 0 is served after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 4096
#: A step of a small source is length / STEPS tokens; shares of 0 count as LEAST_SHARE of the source's own.
STEPS, LEAST_SHARE = 64, 1e-6

ENCODED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _encode(path: str, memo_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, pack = tokens.encoder_of(path, memo_pieces), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                ids, at = encoder.encode(part.column("text"))
                raw, narrow, wide = memoryview(ids.tobytes()), memoryview(ids.astype("<u2").tobytes()), bool(ids.max(initial=0) > 0xFFFF)
                hashes, bodies, places = [], [], at.tolist()
                for low, high in zip(places, places[1:]):
                    hashes.append(int.from_bytes(hashlib.blake2b(raw[4 * low : 4 * high], digest_size=8).digest(), "little", signed=True))
                    broad = wide and bool(ids[low:high].max() > 0xFFFF)
                    bodies.append(bytes([broad]) + pack(raw[4 * low : 4 * high] if broad else narrow[2 * low : 2 * high]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("source"), pa.array(hashes, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(bodies, pa.binary())], schema=ENCODED)

    return run


def _cut(length: int):
    """Cuts documents into the parts that rounds serve, and these at the sequences' edges. Pieces in order are the ids as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in (part for whole in batches for part in tokens.slices(whole, "body")):
            parts = batch.column("parts")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(parts)))
            start, size, at = (np.asarray(pc.struct_field(parts.flatten(), c), dtype=np.int64) for c in ("start", "size", "at"))
            order = np.lexsort((start, row))
            row, start, size, at = row[order], start[order], size[order], at[order]
            many = (at + size - 1) // length - at // length + 1
            part = np.repeat(np.arange(len(at)), many)
            sequence = at[part] // length + np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
            low, high = np.maximum(at[part], sequence * length), np.minimum(at[part] + size[part], (sequence + 1) * length)
            begin, take = start[part] + low - at[part], high - low
            n = np.asarray(batch.column("n"), dtype=np.int64)
            ends = np.cumsum(take)
            if not np.array_equal(ends - take, (np.cumsum(n) - n)[row[part]] + begin) or ends[-1] != n.sum():
                raise ValueError("the parts of a document are not all of it, each id once")
            ids = b"".join(np.frombuffer(unpack(body[1:]), "<u4" if body[0] else "<u2").astype("<u4").tobytes() for body in batch.column("body").to_pylist())
            bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(take), [None, pa.py_buffer(np.append(0, 4 * ends)), pa.py_buffer(ids)]).cast(pa.binary())
            whose = pa.array(row[part])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(whose), pa.array(begin), pa.array(take), bodies, batch.column("n").take(whose), pa.array(sequence), pa.array(low % length)], schema=PIECES)

    return run


def clock(share: DataFrame) -> list[tuple[float, float, float]]:
    """(time, tokens served by then, shares still served from then on), ascending from time 0.

    A source of share p has served min(p * time, its tokens). Sources without a target all end at the same time,
    so there are at most as many places as targets and two more.
    """
    ends = share.groupBy(F.col("end")).agg(F.sum("source_tokens").alias("n"), F.sum("share").alias("p")).orderBy("end").collect()
    left, gone, out = sum(r["p"] for r in ends), 0.0, []
    out.append((0.0, 0.0, left))
    for r in ends[:-1]:
        left, gone = left - r["p"], gone + r["n"]
        out.append((r["end"], gone + left * r["end"], left))
    return out


def _time_at(tokens_served: Column, places: list[tuple[float, float, float]]) -> Column:
    """The time at which so many tokens are served."""
    out = F.lit(None).cast("double")
    for time, served, left in places:
        out = F.when(tokens_served >= F.lit(served), F.lit(time) + (tokens_served - F.lit(served)) / F.lit(left)).otherwise(out)
    return out


def _served_at(time: Column, places: list[tuple[float, float, float]]) -> Column:
    """How many tokens are served at that time."""
    out = F.lit(None).cast("double")
    for start, served, left in places:
        out = F.when(time >= F.lit(start), F.lit(served) + (time - F.lit(start)) * F.lit(left)).otherwise(out)
    return out


def pack(docs: DataFrame, tokenizer: str, targets: DataFrame | None = None, length: int = LENGTH, round_tokens: int | None = None, memo_pieces: int = 300_000) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    targets: (source, share), shares of a round's tokens; a source without one gets its own share of all tokens.
    round_tokens: tokens of a round, one sequence by default.
    """
    size = round_tokens or length
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    encoded = common.written(rows.mapInArrow(_encode(tokenizer, memo_pieces), "doc_id long, source string, h long, n long, body binary"), "encoded")
    meta = encoded.select("doc_id", "source", "h", "n")
    per = meta.groupBy("source").agg(F.sum("n").alias("source_tokens"))
    total = meta.agg(F.sum("n")).first()[0] or 1
    share = per.withColumn("own", F.col("source_tokens") / F.lit(total)).withColumn("share", F.col("own"))
    if targets is not None:
        aim = targets.select(F.col("source").alias("_s"), F.col("share").alias("_share"))
        share = share.join(aim, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("share", F.coalesce("_share", "share")).drop("_s", "_share")
        share = share.withColumn("share", F.greatest(F.col("share").cast("double"), F.col("own") * LEAST_SHARE))
    # When the source ends; the same for all that have their own share.
    end = F.when(F.col("share") == F.col("own"), F.lit(float(total))).otherwise(F.col("source_tokens") / F.col("share"))
    share = common.written(share.withColumn("end", end), "shares")
    places = clock(share) or [(0.0, 0.0, 1.0)]
    step = F.when(F.col("share") * size < max(1, length // STEPS), max(1, length // STEPS)).otherwise(1)
    fraction = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = share.select(F.col("source").alias("_s"), "share", "source_tokens", step.alias("step"), fraction.alias("fraction"))

    queued = common.running_total(meta, F.col("doc_id"), [F.col("h")], {"before": F.col("n")}, ["source"])
    queued = queued.join(share, F.col("source").eqNullSafe(F.col("_s")), "left")
    last = (total + size - 1) // size - 1
    time_of = lambda tokens_of: F.greatest(F.lit(0.0), tokens_of) / F.col("share")
    guess = lambda tokens_of: F.floor(_served_at(time_of(tokens_of), places) / size).cast("long")
    around = F.sequence(F.greatest(F.lit(0).cast("long"), F.least(F.lit(last), guess(F.col("before") - F.col("step"))) - 1), F.greatest(F.lit(0).cast("long"), F.least(F.lit(last), guess(F.col("before") + F.col("n") + F.col("step")) + 1)))
    steps = F.floor(F.col("share") * _time_at(F.col("round").cast("double") * size, places) / F.col("step") + F.col("fraction"))
    following = F.floor(F.col("share") * _time_at((F.col("round") + 1).cast("double") * size, places) / F.col("step") + F.col("fraction"))
    served = lambda k: F.least(F.col("source_tokens"), k.cast("long") * F.col("step"))
    # The queue's part that a round serves, and what of it is this document's.
    low = F.when(F.col("round") == 0, 0).otherwise(served(steps))
    high = F.when(F.col("round") >= last, F.col("source_tokens")).otherwise(served(following))
    pieces = queued.withColumn("round", F.explode(around)).withColumns({"low": F.greatest(low, "before"), "high": F.least(high, F.col("before") + F.col("n"))}).where("low < high")
    pieces = common.written(pieces.select("doc_id", "source", "h", "n", "before", "round", "low", (F.col("high") - F.col("low")).alias("size")), "served")
    placed = common.running_total(pieces, F.col("round"), [F.col("source"), F.col("low")], {"at": F.col("size")})
    whole = placed.groupBy("doc_id", "source", "h", "n", "before").agg(F.collect_list(F.struct((F.col("low") - F.col("before")).alias("start"), "size", "at")).alias("parts"))
    bodies = encoded.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("h").alias("_h"), "body").dropDuplicates(["_d", "_s", "_h"])
    same = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("source").eqNullSafe(F.col("_s")), F.col("h") == F.col("_h")]
    return whole.join(bodies, same).select("doc_id", "n", "body", "parts").mapInArrow(_cut(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed to their sources' own token shares."""
    import public_tokenizers

    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
