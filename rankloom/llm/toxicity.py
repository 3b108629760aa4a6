"""Toxicity by maximum-scoring segments.

Training counts, over labelled documents, in how many toxic and other documents each word and each word
beginning occurs. A word's share of toxic documents is smoothed by a chain of Dirichlet priors: the root's
share is the prior of beginnings of 3 letters, theirs of 4 letters, and so on up to the word, so unseen
words take the odds of their beginnings. A token's score is its log-odds against the root less a drift,
which makes the expected score of ordinary text negative.

A linear scan finds every maximal scoring segment of a text. Of segments of ordinary text the highest is
extreme-value distributed: exp(-K n e^(-lambda S)) with lambda from the scores' own distribution, so
lambda S - log(K n) compares texts of all lengths. A rising curve over this statistic (isotonic regression
on training documents) gives the score between 0 and 1.

The model is bounded: at most about `train_docs` labelled documents are used (a hash of doc_id draws them),
and only tokens are kept whose odds differ from their prior's. Everything else covers all documents, and
labels, lang, source and doc_id are never inputs of a score. Defined cases: a text without words (null or
empty) has the statistic of an empty scan; repeated rows score alike; without labels of both kinds every
score is the smoothed base rate; other columns are ignored; long texts take time in proportion.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_DOCS = 40_000
FIRST, LAST = 3, 6
#: Weight of the prior in each step of the chain, in documents.
STRENGTH = 4.0
DRIFT = 1.5
#: A token is kept if its score differs from that of its prior by this much, and at least so many documents hold it.
DIFFERENT, LEAST_DOCS = 0.7, 3
LIMIT = 0.7
#: A toxic training document counts so often in the curve: missing one costs more than rejecting a clean one.
TOXIC_WEIGHT = 2.0
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _beginnings(word: str) -> list[str]:
    """Longest first: the word itself (marked), then its beginnings."""
    return [word + "$", *(word[:k] for k in range(min(LAST, len(word)), FIRST - 1, -1))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by token and label, added up within a task as far as memory is to be kept small."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        items = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.string()), pa.array([v[0] for _, v in items], pa.int64()), pa.array([v[1] for _, v in items], pa.int64())], names=["token", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for token in {b for w in set(WORD.findall((text or "").lower())) for b in _beginnings(w)}:
                counts.setdefault(token, [0, 0])[toxic] += 1
            if len(counts) > 300_000:
                yield out()
    yield out()


class Model:
    """Scores of tokens and the calibration; a few MB at most."""

    def __init__(self, scores: dict[str, float], root: float, lam: float, log_k: float, knots: tuple[list[float], list[float]]):
        self.scores, self.root, self.lam, self.log_k, self.knots = scores, root, lam, log_k, knots

    def word(self, word: str) -> float:
        get = self.scores.get
        for token in _beginnings(word):
            if (s := get(token)) is not None:
                return s
        return self.root


class Scanner:
    """Scores texts; remembers the scores of words."""

    def __init__(self, model: Model, memo_words: int = 200_000):
        self.model, self.memo, self.memo_words = model, {}, memo_words

    def values(self, text: str | None) -> np.ndarray:
        memo, word = self.memo, self.model.word
        found = []
        for w in WORD.findall((text or "").lower()):
            s = memo.get(w)
            if s is None:
                s = word(w)
                if len(memo) < self.memo_words:
                    memo[w] = s
            found.append(s)
        return np.array(found, dtype=np.float64)

    def statistic(self, text: str | None) -> float:
        """Evidence of all segments: minus the log of the chance that r of them are so high in clean text, for the r that makes it least.

        For normalised scores x the number of segments from x on is Poisson with mean exp(-x), so r of them have a
        chance of at most exp(-r x) / r! for the lowest; their sum T has the tail exp(-T) T**(r - 1) / (r! (r - 1)!)
        (Karlin and Altschul 1993), which holds from T = r (r + 1) on.
        """
        values = self.values(text)
        m = self.model
        base = -(m.log_k + log(max(len(values), 1)))
        x = m.lam * np.sort([s for _, _, s in segments(values)])[::-1] + base
        if not len(x):
            return base
        best, total = float(x[0]), 0.0
        for r, own in enumerate(x[x > 0].tolist(), 1):
            total += own
            best = max(best, r * own + lgamma(r + 1))
            if r > 1 and total >= r * (r + 1):
                best = max(best, total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r))
        return best

    def score(self, text: str | None) -> float:
        x = self.statistic(text)
        rough = 1 / (1 + exp(-max(-50.0, min(50.0, x / 4))))  # orders texts that share a level of the curve
        return 0.98 * float(np.interp(x, *self.model.knots)) + 0.02 * rough


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time; only positive tokens are visited one by one."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    # Each kept segment is (start, end, sum before, sum with); `back` names the nearest one whose start is lower.
    kept: list[tuple[int, int, float, float]] = []
    back: list[int] = []
    for k in np.flatnonzero(values > 0).tolist():
        start, end, left, right = k, k + 1, float(total[k]), float(total[k + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = back[j]
            if j < 0 or kept[j][3] >= right:
                kept.append((start, end, left, right))
                back.append(j)
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:], back[j:]
    return [(s, e, r - l) for s, e, l, r in kept]


def _chain(counts: dict[str, tuple[int, int]], root: float) -> dict[str, float]:
    """Smoothed log-odds of every token that says more than its prior does."""
    base, shares, kept = log(root / (1 - root)), {}, {}
    # Beginnings before the longer ones, words last.
    for token in sorted(counts, key=lambda t: (t.endswith("$"), len(t))):
        prior, prior_score = root, None
        for b in _beginnings(token[:-1])[1:] if token.endswith("$") else [token[:k] for k in range(len(token) - 1, FIRST - 1, -1)]:
            if b in shares:
                prior = shares[b]
                break
        clean, toxic = counts[token]
        share = (toxic + STRENGTH * prior) / (clean + toxic + STRENGTH)
        shares[token] = share
        prior_score = log(prior / (1 - prior)) - base
        score = log(share / (1 - share)) - base
        if clean + toxic >= LEAST_DOCS and abs(score - prior_score) >= DIFFERENT:
            kept[token] = score - DRIFT
    return kept


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 11) -> Model:
    """Fits the model on labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > train_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * train_docs / n))
    # Bounded: about train_docs rows of 12 bytes.
    known = F.broadcast(known.select(F.col("doc_id").alias("_id"), "toxic"))
    sample = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(known, F.col("_d") == F.col("_id")).select("text", "toxic")
    per = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = per.get(0, 0), per.get(1, 0)
    root = (toxic + 1) / (clean + toxic + 10)
    if not clean or not toxic:
        return Model({}, -DRIFT, 1.0, 0.0, ([0.0], [root]))
    counted = sample.mapInArrow(_count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Tokens whose share of toxic documents is near the root's change nothing; the others are bounded by the sample.
    share = (F.col("toxic") + STRENGTH * root) / (F.col("clean") + F.col("toxic") + STRENGTH)
    odds = F.log(share / (1 - share)) - log(root / (1 - root))
    telling = counted.where((F.col("clean") + F.col("toxic") >= LEAST_DOCS) & (F.abs(odds) >= DIFFERENT / 2))
    rows = telling.toPandas()
    counts = {t: (int(c), int(x)) for t, c, x in zip(rows["token"], rows["clean"], rows["toxic"])}
    model = Model(_chain(counts, root), -DRIFT, 1.0, 0.0, ([0.0], [root]))
    return calibrate(model, sample)


def calibrate(model: Model, sample: DataFrame, bins: int = 400) -> Model:
    """Extreme-value parameters from the scores of clean documents, then the rising curve."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = Scanner(shared.value), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found, times = np.unique(np.round(scanner.values(text) * 4), return_counts=True)
                seen.update(dict(zip(found.astype(int).tolist(), times.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["value", "n"])

    values = {r["value"] / 4: r["n"] for r in sample.where("toxic = 0").mapInArrow(spread, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()}
    total = sum(values.values()) or 1
    low, high = 0.01, 5.0
    if any(v > 0 for v in values):
        for _ in range(60):  # the positive root of E[exp(lambda s)] = 1
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * exp(mid * v) for v, n in values.items()) / total < 1 else (low, mid)
    model.lam = max(low, 0.05) if any(v > 0 for v in values) else 1.0
    # Segments can only start at positive tokens: K is taken as their share in clean text.
    model.log_k = log(max((sum(n for v, n in values.items() if v > 0) + 1) / (total + 1), 1e-9))
    again = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = Scanner(again.value), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[(int(np.clip(np.floor(scanner.statistic(text) * 4), -bins, bins)), toxic)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["bin", "toxic", "n"])

    rows = sample.mapInArrow(place, "bin long, toxic long, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).collect()
    x, y, w = (np.array(c, dtype=float) for c in zip(*[((r["bin"] + 0.5) / 4, r["toxic"], r["n"]) for r in rows]))
    model.knots = _rising(x, y, np.where(y > 0, TOXIC_WEIGHT * w, w))
    return model


def _rising(x: np.ndarray, y: np.ndarray, w: np.ndarray, most: int = 64) -> tuple[list[float], list[float]]:
    """Isotonic regression by pooling neighbours: knots (statistic, probability) of a curve that never falls."""
    blocks: list[list[float]] = []
    for k in np.lexsort((y, x)):
        blocks.append([w[k] * x[k], w[k] * y[k], w[k], x[k]])
        if len(blocks) > 1 and blocks[-2][3] == x[k]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2], x[k]]
    pooled: list[list[float]] = []
    for b in blocks:
        pooled.append(b)
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][2] >= pooled[-1][1] / pooled[-1][2]:
            last = pooled.pop()
            pooled[-1] = [pooled[-1][0] + last[0], pooled[-1][1] + last[1], pooled[-1][2] + last[2], last[3]]
    base = float(np.average(y, weights=w))
    return [b[0] / b[2] for b in pooled], [(b[1] + base) / (b[2] + 1) for b in pooled]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scanner.score(t) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def below(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scanner.score(t) < limit for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: Model, least: float = 3.0) -> DataFrame:
    """doc_id, first and last word (counted from 0), statistic of every significant segment."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, m = Scanner(shared.value), shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                values = scanner.values(text)
                base = -(m.log_k + log(max(len(values), 1)))
                rows += [(doc_id, s, e - 1, m.lam * v + base) for s, e, v in segments(values) if m.lam * v + base >= least]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["doc_id", "first", "last", "statistic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first long, last long, statistic double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
