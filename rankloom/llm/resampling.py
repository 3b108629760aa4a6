"""Importance resampling towards a target distribution, by hashed features and an exact integer-score histogram.

Words and word pairs are hashed into a fixed number of buckets. A bucket's gain is the log ratio of its share in
the target texts to its share in all documents; a document's weight is the floored mean of the gains of its
features. A Gumbel number of the doc_id is added, so that the highest scores are a draw without replacement in
proportion to exp(weight / 1000).

The draw needs no sort of all documents. Scores are integers: a histogram counts the documents of each, the
counts of all higher scores (a suffix sum over the histogram) are the rank before a score's first document, and the
cutoff is the lowest score whose suffix sum is below the number drawn. Only documents at or above it are numbered, by
doc_id within their score. A score of very many documents is numbered in runs of doc_id (run_rows).

Sizes: the two feature histograms have `buckets` rows, whatever the input; the score histogram has one row a distinct
score, and scores are sums of logarithms of counts, so they lie within about +-100,000 at any size. Texts are read
twice (features, weights), in blocks of words.

Defined cases: null and empty texts have no feature and weight 0, and are never drawn as they have too few words;
a null doc_id has the Gumbel number of the empty string and stands last in its score; rows alike are drawn each
by itself; without target texts all counts of the target are 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens, words

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: Documents of one score that one task numbers, about.
RUN_ROWS = 4_000_000
SCALE = 4294967296
SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def features(text: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of a text: the number of its words, and the buckets of the words and pairs that end in it."""
    last = None
    for found in words.blocks(text):
        single = list(map(zlib.crc32, found))
        # crc32 of "a b" goes on from that of "a".
        after = [b" " + w for w in (found if last is not None else found[1:])]
        pairs = list(map(zlib.crc32, after, single if last is None else [last, *single]))
        if single:
            last = single[-1]
        yield len(single), np.array(single + pairs, dtype=np.int64) % buckets


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(buckets, dtype=np.int64), [], 0
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                for text in words.raw_texts(part.column("text")):
                    for _, found in features(text, buckets):
                        held.append(found)
                        n += len(found)
                        if n >= words.BLOCK:
                            total += np.bincount(np.concatenate(held), minlength=buckets)
                            held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def feature_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one row a bucket at most."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_counts(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of smoothed shares, for each bucket."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (all_s + n)) / float((s + 1) * (all_t + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / SCALE)))


def _scores(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                ids, rows = part.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, words.raw_texts(part.column("text"))):
                    n_words = n = total = 0
                    for count, found in features(text, len(gain)):
                        n_words, n, total = n_words + count, n + len(found), total + int(gain[found].sum())
                    weight = total // n if n else 0
                    rows.append((n_words, n, weight, weight + gumbel(doc_id, seed)))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], schema=SCORED)

    return run


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    gain = gains(feature_counts(docs, buckets), feature_counts(target, buckets))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scores(gain, seed), "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run_rows: int = RUN_ROWS) -> DataFrame:
    """The rows of scored(), written before, with `rank` in falling score of the share of eligible documents drawn; null for all others."""
    eligible = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    histogram = common.written(rows.where(eligible).groupBy("score").agg(F.count("*").alias("n")), "histogram")
    said = histogram.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    take = percent * (said["n"] or 0) // 100
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = histogram.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above")).where(F.col("above") < take)
    cutoff = offsets.agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long")
    if cutoff is None:
        return rows.withColumn("rank", none)
    inside = eligible & (F.col("score") >= cutoff)
    placed = rows.where(inside).join(common.small_enough(offsets), "score")
    order = [F.col("n_features"), F.col("weight")]
    id_key = F.col("doc_id")
    bounds = common.even_bounds(placed, id_key, max(1, said["most"] // run_rows))
    placed = placed.withColumn("run", F.when(id_key.isNull(), len(bounds) + 1).otherwise(common.bucket_of(id_key, bounds)))
    if bounds:
        earlier = Window.partitionBy("score").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        base = placed.groupBy("score", "run").agg(F.count("*").alias("n")).select("score", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        placed = placed.join(base, ["score", "run"])
    else:
        placed = placed.withColumn("run", F.lit(0)).withColumn("before", F.lit(0))
    within = Window.partitionBy("score", "run").orderBy(id_key.asc_nulls_last(), *order)
    rank = F.col("above") + F.col("before") + F.row_number().over(within)
    placed = placed.select(*rows.columns, rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return placed.unionByName(rows.where(~inside).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document: rank 1, 2, 3 ... for the drawn ones."""
    return drawn(common.written(scored(docs, target, buckets, seed), "scored"), percent, least_words, run_rows)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark's texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL of the query; the checksum goes byte by byte through the table of its polynomial.
OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), words AS (
  SELECT side, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM texts
), features AS (
  SELECT side, doc_id, f, count(*) AS n
  FROM (SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words) GROUP BY ALL
), bytes AS (
  SELECT f, list_transform(range(0, strlen(f)), lambda i: ('0x' || substring(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT f FROM features)
), buckets AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc_table
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM features JOIN buckets USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM counts
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scores AS (
  SELECT w.doc_id, len(w.w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words w LEFT JOIN weights USING (doc_id) WHERE side = 0
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS take FROM scores WHERE able
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= take THEN place END AS rank FROM scores LEFT JOIN places USING (doc_id)
"""
