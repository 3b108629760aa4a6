"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

Documents are dealt into shards, each of which fits a task: a list of documents per query term, sorted by falling
impact, and a forward index from a document and a term to the impact. A query reads its terms' lists in turn, so
many entries of each at a time; every document seen for the first time is looked up in the forward index for its
whole score. The threshold is the score that the last entries read would give together: no unseen document of the
shard can have more. The query ends when it is strictly below the k-th score, so documents that tie are all seen.
The k-th score is carried from shard to shard of a task. The best k of all tasks are merged in two steps, by item
and a hash of the document first, so that no group grows with the number of tasks alone.

Weights and lengths are those of all documents (df, N, L), counted in a pass of its own, so shards give the scores
of one index over everything. Queries are taken in blocks of so many distinct terms (block_terms, one query at
least), each of which goes to every task; each block is two passes over the documents.

Defined cases: null and empty texts, and texts without a term, are no documents; a query without a term has no
row; rows of items that are alike count once, and rows with one id and different texts are queries of their own; a
repeated document is ranked as often as it occurs; a null doc_id stands after all others of its score; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens, words

TOP, BLOCK_TERMS = 10, 8192
#: Bytes of a shard's forward index; entries of each list that a round reads first (doubled each round).
SHARD_BYTES, DEPTH = 64 << 20, 16
#: Groups of an item whose best are found before they meet.
GROUPS = 64
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def query_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, terms with their repeats) of all items with a term, in blocks of about `most` distinct terms."""
    held, seen = [], set()
    for row in items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct().toLocalIterator():
        terms = Counter(w for block in words.blocks(row["text"].encode()) for w in block)
        if not terms:
            continue
        if held and len(seen | terms.keys()) > most:
            yield held
            held, seen = [], set()
        held.append((row["item_id"], terms))
        seen |= terms.keys()
    if held:
        yield held


def _statistics(codes: dict[bytes, int]):
    """Per task: documents holding each term, at code -1 all documents, at code -2 all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(codes), dtype=np.int64), 0, 0
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                for text in words.raw_texts(part.column("text")):
                    n, held = 0, set()
                    for found in words.blocks(text):
                        n += len(found)
                        held |= codes.keys() & set(found)
                    if n:
                        n_docs, n_terms = n_docs + 1, n_terms + n
                        df[[codes[w] for w in held]] += 1
        at = np.flatnonzero(df)
        code, count = np.concatenate((at, [-1, -2])), np.concatenate((df[at], [n_docs, n_terms]))
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(count, pa.int64())], names=["code", "n"])

    return run


class Shard:
    """Documents of a part of a task: forward index, and lists by falling impact."""

    def __init__(self, n_terms: int, rows: int):
        self.forward = np.zeros((rows, n_terms), dtype=np.int32)
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, codes: np.ndarray, impacts: np.ndarray) -> bool:
        """Takes a document; whether the shard is full then."""
        self.forward[len(self.ids), codes] = impacts
        self.ids.append(doc_id)
        return len(self.ids) == len(self.forward)

    def close(self) -> None:
        self.forward = self.forward[: len(self.ids)]
        doc, term = np.nonzero(self.forward)
        impact = self.forward[doc, term]
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order].astype(np.int64)
        self.starts = np.searchsorted(term[order], np.arange(self.forward.shape[1] + 1))
        self.missing = np.array([i is None for i in self.ids], dtype=bool)
        self.id = np.array([i or 0 for i in self.ids], dtype=np.int64)

    def search(self, terms: np.ndarray, factors: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k (score, missing id, id) of `best` and this shard by the threshold algorithm."""
        first, length = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        held = length > 0
        terms, factors, first, length = terms[held], factors[held], first[held], length[held]
        seen, depth, step = np.zeros(len(self.ids), dtype=bool), 0, DEPTH
        while len(length) and depth < length.max():
            # No unseen document can have more than the last entries read give together (at first: the lists' heads).
            going = length > depth
            threshold = int((factors[going] * self.impact[first[going] + max(0, depth - 1)]).sum())
            if len(best[0]) >= k and threshold < best[0][k - 1]:
                break
            # One round: so many entries of each list that is not at its end.
            upto = np.minimum(depth + step, length)
            read = np.concatenate([self.doc[f + depth : f + u] for f, u in zip(first.tolist(), upto.tolist()) if u > depth])
            fresh = np.unique(read[~seen[read]])
            seen[fresh] = True
            score = self.forward[np.ix_(fresh, terms)].astype(np.int64) @ factors
            good = score >= (best[0][k - 1] if len(best[0]) >= k else 1)
            if good.any():
                fresh = fresh[good]
                score, missing, ids = (np.concatenate(pair) for pair in zip(best, (score[good], self.missing[fresh], self.id[fresh])))
                order = np.lexsort((ids, missing, -score))[:k]
                best = score[order], missing[order], ids[order]
            depth, step = depth + step, step * 2
        return best


def _search(codes: dict[bytes, int], queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(16, shard_bytes // (4 * max(1, len(codes))))
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)
        shard = Shard(len(codes), rows)

        def finish() -> None:
            shard.close()
            for q, (terms, factors) in enumerate(queries):
                best[q] = shard.search(terms, factors, best[q], k)

        for batch in batches:
            for part in tokens.slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), words.raw_texts(part.column("text"))):
                    n, held = 0, Counter()
                    for found in words.blocks(text):
                        n += len(found)
                        held.update(c for w in found if (c := codes.get(w)) is not None)
                    if not held:
                        continue
                    m = 25 + 75 * n * n_docs // n_terms
                    tf = np.fromiter(held.values(), np.int64, len(held))
                    full = shard.add(doc_id, np.fromiter(held.keys(), np.int64, len(held)), 1_000_000_000 * tf // (1000 * tf + 8 * m))
                    if full:
                        finish()
                        shard = Shard(len(codes), rows)
        if shard.ids:
            finish()
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b[0]) for b in best])
        score, missing, ids = (np.concatenate([b[c] for b in best]) if best else np.zeros(0, np.int64) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())], schema=FOUND)

    return run


def _best(found: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item (item_id, text)."""
    spark, rows = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    key = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {key}, rank int, doc_id long, score long")
    for block in query_blocks(items, block_terms):
        codes = {w: c for c, w in enumerate(sorted({w for _, terms in block for w in terms}))}
        counts = {r["code"]: r["n"] for r in rows.select("text").mapInArrow(_statistics(codes), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        if not n_docs:
            continue
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(c, 0) + 1))) for c in range(len(codes))]
        queries = []
        for _, terms in block:
            used = [(codes[w], weight[codes[w]] * n) for w, n in terms.items() if weight[codes[w]] > 0]
            queries.append((np.array([c for c, _ in used], dtype=np.int64), np.array([f for _, f in used], dtype=np.int64)))
        found = rows.mapInArrow(_search(codes, queries, n_docs, n_terms, k, shard_bytes), "item int, doc_id long, score long")
        group = F.pmod(F.xxhash64("doc_id", "score"), F.lit(GROUPS))
        best = _best(_best(found.withColumn("group", group), ["item", "group"], k), ["item"], k)
        ids = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(block)], f"item int, item_id {key}")
        out = out.unionByName(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out


#: DuckDB SQL of the query.
OP13_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
), totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), queries AS (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM queries JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)
