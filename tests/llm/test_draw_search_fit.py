"""Resampling, ranked search and exact-complement packing against brute force, on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankloom.llm import exactfit, resampling, search, words
from tests.llm.test_operators import TEXTS, docs, empty, rows_of  # noqa: F401

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "word1 Word2 word3, changed"), (2, "t5 t6 t5 straße LINE"), (3, None), (4, ""), (5, "..."), (6, "nowhere absent"), (None, "word1 one"), (1, "x z mixed"), (7, "word7"), (7, "word7")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("score", F.lit("clash"))


def terms(text):
    return WORDS.findall((text or "").translate(LOWER))


def test_words_in_blocks():
    text = ("Ab,cd é9-" * 50 + "z" * 90 + " end").encode()
    assert [w for b in words.blocks(text, 16) for w in b] == [w.encode() for w in terms(text.decode())] == next(words.blocks(text))


def brute_draw(rows, target, buckets, percent, least):
    def found(text):
        w = terms(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(found(text))
    for text in target:
        t.update(found(text))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        f = found(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    take = percent * len(able) // 100
    rank = defaultdict(list)
    for k, r in enumerate(able):
        rank[tuple(r)].append(k + 1 if k < take else None)
    return sorted((tuple(r[:4]) + (rank[tuple(r)].pop() if r[4] else None,) for r in out), key=repr)


@pytest.mark.parametrize("percent,run_rows,buckets", [(25, 4_000_000, 10_000), (70, 1, 97), (100, 2, 5), (0, 1, 10)])
def test_resampling(spark, docs, items, percent, run_rows, buckets):  # noqa: F811
    got = resampling.resample(docs.withColumn("rank", F.lit("clash")), items, percent=percent, least_words=5, buckets=buckets, run_rows=run_rows)
    want = brute_draw(rows_of(docs), [r["text"] for r in items.collect()], buckets, percent, 5)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == want


def test_resampling_ties_in_runs(spark):
    """One score for thousands of rows: equal doc_ids and texts, numbered in several runs."""
    rows = spark.range(3000).select(F.expr("id div 3").alias("doc_id"), F.lit("a b c d e").alias("text"))
    table = resampling.scored(rows, rows.limit(0)).withColumn("score", F.lit(5).cast("long"))
    path = table.cache()
    got = [(r["rank"], r["doc_id"]) for r in resampling.drawn(path, 50, 1, run_rows=100).where("rank is not null").collect()]
    assert sorted(got) == [(k + 1, k // 3) for k in range(1500)]


def test_resampling_empty(spark, docs, empty, items):  # noqa: F811
    assert resampling.resample(empty, items).collect() == []
    assert resampling.resample(docs, items.limit(0)).count() == docs.count()


def brute_search(rows, asked, k):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in rows]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    weight = lambda w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
    out = []
    for item_id, text in set(asked):
        q = Counter(terms(text))
        scores = []
        for doc_id, c in held:
            m = 25 + 75 * c.total() * n_docs // n_terms
            scores.append((sum(n * weight(w) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w, n in q.items() if c[w]), doc_id))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item_id, r + 1, doc_id, score) for r, (score, doc_id) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,block_terms,shard_bytes", [(10, 8192, 64 << 20), (3, 4, 64), (1, 1, 1)])
def test_search(spark, docs, items, k, block_terms, shard_bytes):  # noqa: F811
    got = search.search(docs, items, k=k, block_terms=block_terms, shard_bytes=shard_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_search(rows_of(docs), [(r["item_id"], r["text"]) for r in items.collect()], k)


def test_search_many_ties(spark, items):
    """Hundreds of copies tie for the last place: the smallest ids win, in any order of the rows."""
    base = [(i * 7919 % 1000, TEXTS[i % 3 * 5] if i % 4 else "word1 word2 word3 changed") for i in range(1000)]
    table = spark.createDataFrame(base, "doc_id long, text string").repartition(3)
    got = search.search(table, items, shard_bytes=1 << 10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_search(base, [(r["item_id"], r["text"]) for r in items.collect()], 10)


def test_search_stops_early():
    """Lists are not read to their ends once the threshold is below the k-th score."""
    shard = search.Shard(2, 4000)
    for i in range(4000):
        shard.add(i, np.array([0, 1]), np.array([4000 - i, 4000 - i]))
    shard.close()
    looked = []
    forward, shard.forward = shard.forward, type("Counted", (), {"__getitem__": lambda s, at: looked.append(len(at[0])) or forward[at]})()
    best = shard.search(np.array([0, 1]), np.array([2, 3]), (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)), 10)
    assert best[2].tolist() == list(range(10)) and sum(looked) < 100


def test_search_empty(spark, docs, empty, items):  # noqa: F811
    assert search.search(empty, items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert search.search(docs.where("text is null or text = ''"), items).collect() == []


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("length", [1024, 64])
def test_exact_packing(spark, docs, length):  # noqa: F811
    odd = ["a  b\n c \x1c d!\x1c e  ", "<|endoftext|> a <|endoftext|>b  <|endoftext|>", "it's don't 'll  we'll   x  y", "日本 語。 🎉🎉 x", " " * 3000, "<|en", "a  b  c", "café ½ ²"]
    more = spark.createDataFrame([(200 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    table = docs.select("doc_id", "text", F.lit(1).alias("length"), F.lit("x").alias("task"), F.lit("x").alias("ids")).unionByName(more, allowMissingColumns=True)
    rows, want = exactfit.pack(table, BYTES, length).collect(), Counter()
    for doc_id, text in rows_of(table):
        ids = ids_of(text)
        first = len(ids) % length or length
        for piece, start in enumerate([0, *range(first, len(ids), length)]):
            part = ids[start : first if not piece else start + length]
            want[(doc_id, piece, start, len(part), tuple(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= length


def test_exact_packing_empty(spark, empty):  # noqa: F811
    assert exactfit.pack(empty, BYTES).collect() == []


def best_fit(counts, length):
    gaps, used = Counter(), 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fit = min((g for g in gaps if g >= size and gaps[g]), default=None)
            used += fit is None
            fit = length if fit is None else fit
            if fit < length:
                gaps[fit] -= 1
            gaps[fit - size] += 1
    return used


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_few_sequences(seed):
    """Never more sequences than best fit in falling order and one in a hundred, all pieces placed once."""
    rng = np.random.default_rng(seed)
    sizes = [rng.integers(1, 1024, 500), rng.integers(200, 700, 800), np.clip(rng.lognormal(6, 0.5, 900), 1, 1024).astype(int), rng.choice([100, 300, 624, 512, 1024], 700)][seed % 4]
    counts = Counter(sizes.tolist())
    made, placed = exactfit.plan(counts), Counter()
    for pattern, times in made:
        assert sum(pattern) <= 1024 and times > 0
        for size in pattern:
            placed[size] += times
    assert placed == counts and len(made) <= 2 * len(counts)
    assert sum(t for _, t in made) <= best_fit(counts, 1024) * 1.01 + 1


def test_plan_fills_gaps_exactly():
    """A pair and a triple of lengths fill what best fit would leave open."""
    assert sum(t for _, t in exactfit.plan({700: 10, 320: 10, 200: 10, 124: 10})) == 14
    assert exactfit.plan({600: 5, 424: 5}) == [([600, 424], 5)]
    assert exactfit.plan({700: 4, 300: 4, 24: 4}) == [([700, 300, 24], 4)]
    assert exactfit.plan({600: 4, 300: 4, 100: 4, 24: 4}) == [([600, 300, 100, 24], 4)]
