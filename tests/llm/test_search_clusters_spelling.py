"""Top-k search, centroid clustering and spelling variants on small fixtures: brute force, odd rows, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import annulus, sharding, spelling, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int, uid long, shard string, score double, dim string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, "v", 2, 7, "s", 0.5, "d") for i, x in rows], SCHEMA)


def odd_vectors(seed=1, n=400, dims=64):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.125, dims).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[50][1]) for i in range(9)]  # ties
    rows += [(900, None), (901, []), (902, [float("nan")] * dims), (903, [None] * dims), (904, [float("inf")] + [0.0] * (dims - 1)), (905, [0.0] * dims), (950, [1.0, -2.0]), (951, [3.0, 0.5]), (1000, [1e30] * dims), (None, rows[0][1]), (100, rows[7][1]), (-50, rows[3][1])]
    return rows


# --- 11 ------------------------------------------------------------------------------------------------------------------


def plain_top(rows, k=5, divisor=50, scale=256):
    held = []
    for place, (i, x) in enumerate(rows):
        if x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        whole = [int(np.floor(scale * float(np.float32(c)))) for c in x]
        if sum(c * c for c in whole) < 1 << 62:
            held.append((place, i, whole))
    out = []
    for place, i, x in held:
        if i is None or i % divisor:
            continue
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j is None, j or 0, p, j) for p, j, y in held if p != place and len(y) == len(x))
        out += [(i, r + 1, f[4], -f[0]) for r, f in enumerate(found[:k])]
    return Counter(out)


@pytest.mark.parametrize("shard", [2048, 60])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", 5)
    rows = odd_vectors()
    got = topk.top_k(vectors(spark, rows)).select("query_id", "rank", "vec_id", "score")
    assert Counter(tuple(r) for r in got.collect()) == plain_top(rows)
    assert got.schema["rank"].dataType.typeName() == "integer" and got.schema["score"].dataType.typeName() == "long"


def test_top_k_of_few_and_none(spark):
    assert topk.top_k(vectors(spark, [])).collect() == []
    assert topk.top_k(vectors(spark, [(50, [1.0])])).collect() == []
    assert [tuple(r) for r in topk.top_k(vectors(spark, [(50, [1.0]), (3, [-1.0])])).collect()] == [(50, 1, 3, -65536)]


def test_index_stops_before_its_last_segments(spark):
    rng = np.random.default_rng(3)
    near = rng.integers(-60, 60, (20, 32)) * 4
    base = np.concatenate([near, rng.integers(-3, 4, (1500, 32))])
    index = topk.Index.build(base)
    asked, row, score = index.possible(near, np.arange(20), 5)
    assert len(row) < 20 * len(base) / 8
    for q in range(20):
        exact = base @ near[q]
        exact[q] = np.iinfo(np.int64).min
        mine = score[asked == q]
        assert sorted(mine)[-5:] == sorted(exact)[-5:] and (exact[row[asked == q]] == mine).all()
    again = topk.Index.load(index.dump())
    assert (again.rows == index.rows).all() and (again.missing == index.missing).all()


@pytest.mark.parametrize("size", [1, 1000, 1 << 27])
def test_bounds_hold_for_large_and_tied_values(size):
    rng = np.random.default_rng(size)
    base = np.concatenate([rng.integers(-size, size + 1, (300, 8)), np.full((40, 8), size)])
    queries = np.concatenate([base[:10], base[-3:], np.zeros((1, 8), np.int64)])
    own = np.concatenate([np.arange(10), [337, 338, 339, -1]])
    asked, row, score = topk.Index.build(base).possible(queries, own, 5)
    for q in range(len(queries)):
        exact = [sum(int(a) * int(b) for a, b in zip(x, queries[q], strict=True)) for x in base]
        least = sorted(x for i, x in enumerate(exact) if i != own[q])[-5]
        assert {i for i, x in enumerate(exact) if x >= least and i != own[q]} <= set(row[asked == q].tolist())
        assert all(exact[i] == s for i, s in zip(row[asked == q], score[asked == q], strict=True))


# --- 12 ------------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    held = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in x]) for i, x in rows if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) and abs(c) < 131072 for c in x)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in held if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in held:
            groups.setdefault(near(v)[1], []).append(v)
        for n, members in groups.items():
            centroids[n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in held]
    by = Counter()
    for _, d, n in found:
        by[n] += d
    return Counter((i, n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found)


def test_clusters_equal_brute_force(spark):
    rows = odd_vectors(2, 150)
    got = annulus.clusters(vectors(spark, rows), rounds=4)
    assert Counter(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == plain_clusters(rows, rounds=4)
    assert annulus.clusters(vectors(spark, rows[-11:-7])).count() == 0
    few = [(i, [float(i)] * 64) for i in (3, 1, 2)]
    assert Counter(tuple(r) for r in annulus.clusters(vectors(spark, few)).collect()) == plain_clusters(few)
    assert annulus.clusters(vectors(spark, [(None, [1.0] * 64)] * 2)).count() == 2


def test_annulus_compares_candidates_only_and_keeps_ties():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-5, 6, (40, 3)) * np.arange(1, 41)[:, None]
    centroids[7], centroids[9] = centroids[5], -centroids[5]
    points = np.concatenate([rng.integers(-200, 200, (500, 3)), (centroids[:20] + centroids[20:]) // 2, np.zeros((1, 3), np.int64), centroids])
    number, apart, compared = annulus.Annulus(centroids).nearest(points)
    every = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (apart == every.min(1)).all()
    assert compared < 0.8 * every.size


# --- 13 ------------------------------------------------------------------------------------------------------------------


def plain_words(rows):
    import re

    n = Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {w: f if (f := min(xs, key=lambda x: (-n[x], x), default=None)) is not None and n[f] >= 10 * n[w] else None for w, xs in near.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def texts_with_variants(seed=5):
    rng = random.Random(seed)
    letters = "abcdeéßÿ×"
    base = ["".join(rng.choices(letters, k=rng.choice([6, 7, 8, 10]))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaaaa", "ababababab"]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 40, 300])
        for _ in range(8):
            at, kind = rng.randrange(len(w)), rng.choice("rid")
            x = w[:at] + (rng.choice(letters) if kind != "d" else "") + w[at + (kind != "i") :]
            words += [x] * rng.choice([1, 2, 3])
    chain = ["chainword", "chainworda", "chainwordab", "chainwordabc"]
    words += [w for k, w in enumerate(chain) for _ in range(2 * 14**k)]
    rng.shuffle(words)
    words = [w.upper() if rng.random() < 0.1 else w for w in words]
    rows = [(i, rng.choice([" ", "\n", "1", "Ā", "."]).join(words[i::60])) for i in range(60)]
    long = "longrun" * 3000
    return rows + [(None, "nothing nothing"), (None, None), (5, ""), (7, "x" * 50_000 + " " + "x" * 50_000), (7, "repeated repeated"), (7, "repeated repeated"), (8, long + "a " + long + "b"), (9, long + "a " + long + "b " + long), (10, long), (11, "日本語 Привет ŁŁŁŁŁŁŁŁ")]


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "RADIX_ROWS", 500)
    rows = texts_with_variants()
    docs = spark.createDataFrame([(i, t, 3, "w", 1, "r", 2) for i, t in rows], "doc_id long, text string, n int, word string, wid int, root string, key int")
    got = spelling.spelling_variants(docs)
    found = [tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert set(found) == plain_variants(rows) and len(found) == len(set(found))
    assert {r[0]: r[2] for r in found}["chainword"] == "chainwordabc"
    assert spelling.spelling_variants(docs.where("false")).collect() == []


def test_keys_are_equal_exactly_for_equal_rests():
    words = ["abcabca", "abcabcaa", "bcabcaa", "éaéaéaé", "aaaaaaa", "aaaaaa", "x" * 70]
    key, row, kind, place = spelling.deletion_keys(pa.array(words))
    meaning = {}
    for k, r, t, p in zip(key.tolist(), row.tolist(), kind.tolist(), place.tolist(), strict=True):
        w = words[r]
        rest = w if t == spelling.WHOLE else w[:p] + w[p + 1 :]
        meaning.setdefault(k, set()).add((p, len(w), rest) if t == spelling.REPLACED else rest)
    assert all(len(x) == 1 for x in meaning.values())
    assert len(meaning) == len({next(iter(x)) for x in meaning.values()})
    assert sum(kind == spelling.DELETED) == sum(len({w[:i] + w[i + 1 :] for i in range(len(w))}) for w in words)


# --- 3 -------------------------------------------------------------------------------------------------------------------


def test_shards_are_written_row_by_row(spark, tmp_path):
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, "x"), (2, "x"), (2, ""), *[(i, f"text {i}") for i in range(3, 60)]]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, shard int, slot int")
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    assert back.select("__shard").distinct().count() == 4 and {(r["shard"], r["slot"]) for r in back.collect()} == {(5, 6)}
    assert back.groupBy("__shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b")).agg(F.max("b") - F.min("b")).first()[0] < 60
