"""Shards cut from a Hilbert curve over document metadata.

Source and language are ranked among their distinct values. These ranks, size and doc_id are each quantised to 2**BITS levels at their own quantiles, the levels
are interleaved to the place on a Hilbert curve, and the curve is cut into shards of equal row counts.
Shards are then compact boxes in all four dimensions, so minimum and maximum of any of them prune files.

Only SQL functions are used. Quantiles are approximate, but only shift level borders: places, counts and
cuts are exact. Defined cases: nulls take level 0 of their dimension; a null text has size 8 and the CRC of
no bytes; ties of place go by doc_id and CRC; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 6


def text_key(c: Column) -> Column:
    """The first seven bytes of a string as a long that sorts as these bytes do."""
    head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("long")


def with_rank(rows: DataFrame, c: str) -> DataFrame:
    """Adds k_<c>, the number of lesser distinct values of the string column c (null: null)."""
    values = common.written(rows.where(F.col(c).isNotNull()).groupBy(c).agg(text_key(F.col(c)).alias("key")), "values")
    ranked = common.running_total(values, F.col("key"), [F.col(c)], {f"k_{c}": F.lit(1).cast("long")}).select(c, f"k_{c}")
    return rows.join(common.small_enough(common.written(ranked, "ranks")), c, "left")


def hilbert(df: DataFrame, levels: list[Column], out: str, bits: int = BITS) -> DataFrame:
    """Adds the place on the Hilbert curve of a point with `bits` bits in each dimension (Skilling's transposition).

    Each turn of the curve is a projection of its own, so the generated code binds every value once.
    """
    n = len(levels)
    names = [f"_x{i}" for i in range(n)]
    df = df.withColumns({x: level.cast("long") for x, level in zip(names, levels)})
    x = [F.col(name) for name in names]
    for b in range(bits - 1, 0, -1):
        high, low = F.lit(1 << b).cast("long"), F.lit((1 << b) - 1).cast("long")
        for i in range(n):
            flip = x[i].bitwiseAND(high) != 0
            if i == 0:
                df = df.withColumn(names[0], F.when(flip, x[0].bitwiseXOR(low)).otherwise(x[0]))
            else:
                swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
                df = df.withColumns({names[0]: F.when(flip, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap)), names[i]: F.when(flip, x[i]).otherwise(x[i].bitwiseXOR(swap))})
    for i in range(1, n):
        df = df.withColumn(names[i], x[i].bitwiseXOR(x[i - 1]))
    turn = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(x[n - 1].bitwiseAND(F.lit(1 << b).cast("long")) != 0, (1 << b) - 1).otherwise(0).cast("long"))
    df = df.withColumn("_turn", turn)
    df = df.withColumns({name: F.col(name).bitwiseXOR(F.col("_turn")) for name in names})
    place = F.lit(0).cast("long")
    for b in range(bits):
        for i in range(n):
            place = place + F.shiftleft(F.shiftright(x[i], b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - i)
    return df.withColumn(out, place).drop("_turn", *names)


def shard(docs: DataFrame, shards: int = 24, bits: int = BITS) -> DataFrame:
    """The rows of docs (doc_id, text, source, lang) with size, text_crc32, place (on the curve), shard and slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = with_rank(with_rank(common.written(rows, "metadata"), "source"), "lang")
    keys = {"source": F.col("k_source"), "lang": F.col("k_lang"), "size": F.col("size"), "doc_id": F.col("doc_id").cast("long")}
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(k, cuts, 10_000).alias(name) for name, k in keys.items()]).first()
    n = found["n"]
    # Written first: levels that the optimiser took for constants would be folded through every turn of the curve.
    levels = {f"l_{name}": common.bucket_of(k, sorted(set(found[name] or []))) for name, k in keys.items()}
    rows = common.written(rows.select("doc_id", "size", "text_crc32", *[c.alias(name) for name, c in levels.items()]), "levels")
    placed = hilbert(rows, [F.col(name) for name in levels], "place", bits)
    # doc_id in the low bits of the key, so that rows of one place fall into many runs.
    fine = sorted(set(found["doc_id"] or []))
    key = F.shiftleft("place", bits + 1) + common.bucket_of(F.col("doc_id").cast("long"), fine)
    placed = common.written(placed.select("doc_id", "size", "text_crc32", "place", key.alias("key")), "places")
    ranked = common.running_total(placed, F.col("key"), [F.col("doc_id"), F.col("text_crc32")], {"rank": F.lit(1).cast("long")}, buckets=common.bucket_count(n))
    # Shard s holds the ranks from floor(s * n / shards) on: counts differ by one at most.
    own = F.expr(f"((rank + 1) * {shards} - 1) div {max(n, 1)}")
    start = F.expr(f"(shard * {n}) div {shards}")
    return ranked.withColumn("shard", own).withColumn("slot", F.col("rank") - start).select("doc_id", "size", "text_crc32", "place", F.col("shard").cast("int").alias("shard"), "slot")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts along the curve."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
