"""The corpus operators against brute force, on small tables with odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankloom.llm import common, jaccard, mixing, packing, rules, shards, store, toxicity, urls, vectors, warc

VOCAB = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, k int"
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    BASE, BASE, BASE + " more", "  " + BASE.upper() + "\n", "", None, "one two", "ONE\ttwo", "a b c d e f g", "x " * 300, BASE.replace("word30", "changed"),
    "#$ " * 80, "line one here\nline one here\n\nline two", "ÄÖÜ straße élève naïve 'tis <|endoftext|> \x0b mixed\u00a0space", "z" * 5000, "long " + " ".join(f"t{i % 977}" for i in range(20000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "clash", i) for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "en", "s0", 1, "clash", 3), (100, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store(spark, docs):
    path = common.new_path(spark, "store")
    store.write_store(docs, path, VOCAB)
    got = sorted(tuple(r) for r in store.read_store(spark, path).collect())
    want, start = [], 0
    for doc_id, text in sorted(rows_of(docs), key=lambda r: r[0]):
        ids = encoded(text)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(want)
    whole = {r["doc_id"]: r["ids"] for r in store.read_documents(spark, path, [13, 15]).collect()}
    assert whole == {13: encoded(TEXTS[13]), 15: encoded(TEXTS[15])}


def test_store_damage(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write_store(docs, path, VOCAB)
    recipes = spark.read.parquet(f"{path}/recipes").collect()
    spark.createDataFrame(recipes[1:], "row long, doc_id long, start long, n_tokens long, root binary, digests binary, lengths binary").write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError):
        store.read_store(spark, path)


def test_packing(spark, docs):
    pieces = packing.pack(docs, VOCAB, length=256, round_tokens=512).collect()
    want = Counter()
    for doc_id, text in rows_of(docs):
        want[(doc_id, len(encoded(text)))] += 1
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    full = sorted(by)
    assert full == list(range(len(full)))
    for s, own in by.items():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at == 256 or s == full[-1]
    for (doc_id, n), times in want.items():
        own = [p for p in pieces if p["doc_id"] == doc_id and p["doc_tokens"] == n]
        assert sum(p["length"] for p in own) == n * times
        ids = encoded(dict(rows_of(docs))[doc_id])
        for p in own:
            assert p["ids"] == np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()


def window_counts(pieces):
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], Counter())[p["source"]] += p["length"]
    return [by[k] for k in sorted(by)]


def test_packing_windows(spark):
    """Every window holds the sources' shares, with a hot source, a very long document and a very small source."""
    rows = [(i, "a b c d " * (1 + i % 7), "hot" if i % 10 else f"s{i % 3}") for i in range(900)] + [(5000, "long words here " * 9000, "long"), (5001, "tiny one", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = docs.select(F.col("doc_id"), "source")
    pieces = packing.pack(docs, VOCAB, length=512).join(names, "doc_id").collect()
    windows, per = window_counts(pieces), Counter()
    for w in windows:
        per.update(w)
    total = sum(per.values())
    assert len(windows) > 60 and all(sum(w.values()) == 512 for w in windows[:-1])
    for w in windows[:-1]:
        for s, n in per.items():
            step = 8 if 512 * n / total < 8 else 1
            assert abs(w[s] - 512 * n / total) <= 2 * step + 16, (s, w)
    ids = {r[0]: encoded(r[1]) for r in rows}
    seen = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == seen.get(p["doc_id"], 0) and p["ids"] == np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        seen[p["doc_id"]] = p["start"] + p["length"]
    assert seen == {k: len(v) for k, v in ids.items()}


def test_packing_targets(spark):
    """Windows hold the targets until a source has run out, then what is left of them in proportion."""
    rows = [(i, "a b c d e f g h " * 6, f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    aims = spark.createDataFrame([("s0", 0.6), ("s1", 0.3), ("s2", 0.1)], "source string, share double")
    pieces = packing.pack(docs, VOCAB, aims, length=256).join(docs.select("doc_id", "source"), "doc_id").collect()
    windows = window_counts(pieces)
    gone = next(k for k, w in enumerate(windows) if w["s0"] < 147)
    for w in windows[:gone]:
        assert all(abs(w[s] - 256 * p) <= 6 for s, p in (("s0", 0.6), ("s1", 0.3), ("s2", 0.1)))
    assert abs(windows[gone + 1]["s1"] - 192) <= 6 and abs(windows[gone + 1]["s2"] - 64) <= 6 and set(windows[-1]) == {"s2"}
    assert sum(p["length"] for p in pieces) == sum(len(encoded(r[1])) for r in rows)


def test_shards(docs):
    rows = shards.shard(docs, 5).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    assert all(sizes[i] == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert(spark, n, bits):
    from itertools import product

    points = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, [f"d{i}" for i in range(n)])
    path = shards.hilbert(df, [F.col(f"d{i}") for i in range(n)], "place", bits).orderBy("place").collect()
    assert [r["place"] for r in path] == list(range(len(points)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(path, path[1:]))


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), f"s{i % 4}" if i % 9 else None) for i in range(1500)] + [(5000, None, "s1"), (5001, "  ", "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight, free, target, left = {s: k % 3 + 1 for k, s in enumerate(order)}, set(order), {}, float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target[s]) and own[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 2
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, got))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("text like 'w%'").count() == sum(r["copies"] for r in got if r["size"])


def test_rules(docs):
    blank = "\x20\x09-\x0d"
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for doc_id, text in rows_of(docs):
        w = re.findall(f"[^{blank}]+", text or "")
        seen, covered = Counter(zip(w, w[1:], w[2:])), set()
        for k, g in enumerate(zip(w, w[1:], w[2:])):
            if seen[g] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, doc_id
        assert not (r["kept"] and r["base_failed"])


def test_posterior():
    clean, junk = (1, 1, 1, 1, 1), (1, -1, 1, 1, 1)
    found = rules.posterior({clean: 900, junk: 60, (1, 1, -1, -1, 1): 40})
    assert found[clean] > 0.9 and found[junk] < 0.5 and rules.posterior({}) == {}


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                s, t = find(i), find(j)
                parent[max(s, t)] = min(s, t)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(doc_id)
    return {(doc_id, len(sets[k]), min(groups[find(k)])) for k, (doc_id, _) in enumerate(rows)}


def near_copies(n, seed):
    rng = np.random.default_rng(seed)
    base = [f"b{x}" for x in rng.integers(0, 500, 120)]
    out = []
    for i in range(n):
        own = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 5)):
            own[p] = f"e{rng.integers(0, 1000)}"
        out.append((1000 + i, " ".join(own)))
    return out


@pytest.mark.parametrize("block,unit", [(2048, 1_000_000), (8, 500)])
def test_jaccard(spark, docs, monkeypatch, block, unit):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", unit)
    monkeypatch.setattr(jaccard, "SPREAD", 4 if block > 8 else 0)
    rows = rows_of(docs) + near_copies(60, 1) + [(3000 + i, f"same passage of seven words here w{i} " * 3) for i in range(20)]
    got = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((80, 16))
    near = np.concatenate([base[:1] + 0.12 * rng.standard_normal((40, 16)), base[1:2] * 3, base[2:3], base[2:3]])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1e-200] * 16), (905, [1e200] * 16)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    for i, _ in rows:
        want = sum(1 for j in good if i in good and j != i and good[i] @ good[j] >= 0.95)
        assert got[i]["n_links"] == want, i
    assert got[904]["component_id"] == got[905]["component_id"] == 904 and got[901]["kept"]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(4)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((200, 64)), rng.standard_normal((200, 64))))
    a, b = vectors.Codes(x), vectors.Codes(y)
    guess, width = vectors.estimate(a.level, a.step, b.code, b.factor)
    error = guess - x @ y.T
    assert abs(error.mean()) < 0.003 and (np.abs(error) <= width).mean() > 0.9995


def test_urls(spark):
    rows = [
        (1, "https://User.Example.COM/en/1"), (2, "http://www.example.com/en/2?x#y"), (3, "https://a.net/es/9"), (4, "a.net/es/9"), (5, None), (6, "http://b.org?q=/x"),
        (7, "x://notexample.com/en/1"), (8, "http://example.com"), *[(100 + i, f"http://spam.net/es/{i}") for i in range(30)], *[(200 + i, f"http://spam.net/es{i}/{i}") for i in range(3)],
    ]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()}
    assert len(got) == len(rows)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("user.example.com", "/en/1", "example.com/en/", "block")
    assert (got[2]["rule"], got[2]["verdict"], got[2]["path"]) == ("www.example.com/en/", "allow", "/en/2")
    assert (got[3]["rule"], got[3]["verdict"]) == ("net/es/", "block")
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("", "", None, "allow") == (got[5]["host"], got[5]["path"], got[5]["rule"], got[5]["verdict"])
    assert (got[6]["host"], got[6]["path"]) == ("b.org", "") and got[7]["rule"] == "com/" and got[8]["rule"] is None
    assert got[100]["template"] == "/es/<n>" and got[100]["purity"] > 0.8


def test_urls_templates(spark):
    """Blocked by a template alone; sections stay apart at any fan-out; paths keep their depth."""
    import itertools

    names = ["es", "fr", *map("".join, itertools.product("abcdefg", "uvwxyz"))]
    rows = [f"http://spam.net/es/{i}" for i in range(30)] + ["http://spam.net/es"] + [f"http://wide.net/{s}/{i}" for s in names for i in range(16)]
    deep = "http://deep.org/" + "/".join("abcdefghijkl")
    rows += [deep, deep + "/m", "http://clean.org/es"]
    got = {r["url"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), urls.RULES).withColumn("url", F.concat(F.lit("http://"), "host", "path")).collect()}
    assert len(got) == len(rows) and got["http://spam.net/es"]["rule"] is None and got["http://spam.net/es"]["verdict"] == "block"
    assert all(r["verdict"] == ("block" if "/es/" in u or "/fr/" in u else "allow") for u, r in got.items() if "wide.net" in u)
    assert got["http://wide.net/es/3"]["template"] == "/es/<n>" and got["http://wide.net/au/3"]["template"] == "/au/<n>"
    assert got[deep]["template"] == "/" + "/".join("abcdefghijkl") and got[deep + "/m"]["template"] == got[deep]["template"] + "/m" and got["http://clean.org/es"]["verdict"] == "allow"


def test_warc(spark):
    nasty = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 3
    rows = [(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200), (3, None, None), (4, "u\r\nv", nasty), (5, "", nasty), (6, "é", "é" * 99), (7, "s", "short"), (8, "s", "short"), (2, "again", "x" * 200)]
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    import hashlib

    got = sorted(tuple(r)[:5] for r in warc.read_warc(spark, path, block=256).collect())
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        again = len(raw) >= 100 and first != page_id
        want.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want)
    payload = {r["page_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, path, payloads=True).collect() if r["record_type"] == "response"}
    assert payload[4] == nasty.encode() and payload[3] == b""


def test_warc_files_end_by_bytes(spark):
    """Large pages among small ones: no file is larger than its bytes unless by one record."""
    rows = [(i, f"http://a/{i}", ("é" * 20_000 if i % 50 == 7 else "x" * 10) + str(i)) for i in range(1000)] + [(5000, "u", "y" * 300_000), (None, "n", "z" * 120), (None, "n", "z" * 120)]
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, file_bytes=100_000)
    sizes = sorted(r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect())
    assert len(sizes) > 1_400_000 // 100_000 and sizes[-2] <= 100_000 < 300_000 < sizes[-1]
    got = warc.read_warc(spark, path, payloads=True).collect()
    assert Counter((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in got) == Counter(rows) and all(r["record_type"] == "response" for r in got)


def test_warc_long_url(spark):
    """Headers of any length: one page with a long url must not stop the others."""
    rows = [(1, "http://a/", "x" * 200), (2, "data:," + "u" * 300_000, "y" * 150), (3, "http://c/", "z"), (4, "http://d/?" + "é" * 70_000, "y" * 150)]
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = {r["page_id"]: (r["url"], r["payload_bytes"], r["refers_to"]) for r in warc.read_warc(spark, path, block=4096).collect()}
    assert got == {1: (rows[0][1], 200, None), 2: (rows[1][1], 150, None), 3: (rows[2][1], 1, None), 4: (rows[3][1], 150, 2)}


def test_warc_candidates_are_linear():
    import time

    began = time.time()
    assert warc.candidates(warc.MAGIC * 400_000) == [] and warc.candidates(b"") == [] == warc.candidates(b"x:" + warc.MAGIC)
    assert time.time() - began < 5


def toxic_docs(n):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(n):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["the", "and", "cat", "tree", "stone"], 60), rng.choice(["", "s", "ing", "ly"], 60))]
        if bad := bool(rng.random() < 0.25):
            words[10:13] = [f"vile{x}" for x in rng.choice(["ness", "ly", "st", "r"], 3)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_docs(600)
    docs = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = sum((got[i] >= 0.7) != bool(truth[i]) for i in held)
    assert wrong <= 0.03 * len(held) and got[9000] < 0.7 and got[9001] < 0.7 and all(0 <= s <= 1 for s in got.values())
    spans = toxicity.passages(docs, model).collect()
    assert all(s["first"] <= 12 and s["last"] >= 10 for s in spans) and len({s["doc_id"] for s in spans}) >= 0.9 * sum(truth.values())


def test_segments_against_brute_force():
    rng = np.random.default_rng(8)

    def brute(v):
        best, span = 0.0, None
        for i in range(len(v)):
            for j in range(i + 1, len(v) + 1):
                if (s := v[i:j].sum()) > best + 1e-12:
                    best, span = s, (i, j)
        if not span:
            return []
        i, j = span
        return brute(v[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute(v[j:])]

    for _ in range(200):
        v = rng.normal(-0.3, 1, rng.integers(0, 14))
        assert [(a, b) for a, b, _ in toxicity.segments(v)] == [(a, b) for a, b, _ in brute(v)]


@pytest.mark.parametrize("operator", [lambda d: packing.pack(d, VOCAB), shards.shard, mixing.mix, rules.judge, jaccard.near_duplicates], ids=["packing", "shards", "mixing", "rules", "jaccard"])
def test_empty_documents(empty, operator):
    assert operator(empty).count() == 0


def test_empty_store(spark, empty):
    path = common.new_path(spark, "store")
    store.write_store(empty, path, VOCAB)
    assert store.read_store(spark, path).count() == 0


def test_empty_labels(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_empty_vectors_and_urls(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0


def test_empty_warc(spark):
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_shards_without_values(spark):
    """Dimensions that hold nothing, and names alike in their first bytes."""
    rows = [(i, None, None, None) for i in range(9)]
    assert sorted(r["slot"] for r in shards.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 1).collect()) == list(range(9))
    rows = [(i, "t", "en", f"common_crawl_{i % 3}") for i in range(60)]
    got = shards.with_rank(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "source").select("source", "k_source").distinct().collect()
    assert {tuple(r) for r in got} == {(f"common_crawl_{k}", k) for k in range(3)}


def test_toxicity_counts_all_segments():
    """Evidence grows with every significant passage, however many there are."""
    model = toxicity.Model({"vile$": 3.0}, -1.5, 1.0, 0.0, ([0.0], [0.5]))
    found = [toxicity.Scanner(model).statistic(" ".join(["vile vile vile vile vile", "calm " * 40] * n)) for n in (1, 5, 12, 30)]
    assert found == sorted(found) and found[-1] > found[1] + 50


def test_mixing_rows_alike(spark):
    """Many rows of one doc_id and size are one item, and each keeps its own row."""
    docs = spark.createDataFrame([(1, "a b c", "s0")] * 700 + [(2, "a b c", "s1"), (3, "a b", "s1")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 702 and {r["copies"] for r in got if r["source"] == "s0"} <= {0, 1, 2, 3}
    for s in ("s0", "s1"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3


def test_vectors_under_one_id(spark):
    """Different vectors under one vec_id are each compared."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.01, 0.0]), (3, [1.0, 0.01, 0.0, 0.0]), (3, [1.0, 0.01, 0.0, 0.0])]
    got = sorted(tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "n_links").collect())
    assert got == [(1, 1), (1, 2), (2, 1), (3, 2), (3, 2)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    got = dict(map(tuple, common.components(links).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 150: 100, 200: 100}


def test_running_total(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k) if k else None, i, int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 50, 700), rng.integers(0, 9, 700)))]
    got = {r["i"]: r["t"] for r in common.running_total(spark.createDataFrame(rows, "k long, i long, v long"), F.col("k"), [F.col("i")], {"t": F.col("v")}, buckets=16).collect()}
    total, want = 0, {}
    for k, i, v in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        want[i] = total
        total += v
    assert got == want


def test_pipeline(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    docs, sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"
    before = None
    for name, stage in corpus.STAGES:
        out = common.written(stage(spark, docs, sf), name.replace(" ", "-"))
        if name != "packing":
            assert out.columns == docs.columns and out.count() > 0
        if name in ("toxicity", "quality rules", "jaccard join"):
            assert out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
        before, docs = docs, out
    tokens = sum(len(encoded(r["text"])) for r in before.collect())
    assert docs.agg(F.sum("length")).first()[0] == tokens
