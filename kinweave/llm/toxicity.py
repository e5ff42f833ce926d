"""Toxicity: a counterfactual-regularised linear classifier on hashed words and word beginnings.

Fitting, on about TRAIN_ROWS labelled rows drawn by a hash of the id: document frequencies of hashed features are counted by
class on the executors and FEATURES of them with the largest chi-square are chosen; each training text is
then reduced to the chosen features that it holds. For every mention of an identity term, counterfactual sentences
have it swapped for the other terms of its group; the fit adds to the log loss LAMBDA times the mean squared change of the logit
between a sentence and its counterfactuals. The change depends on the features that only one of the two holds, a few of the two terms' own, so all
pairs are counted by those on the executors, and the driver gets the distinct ones. That drives the weights of neutral group mentions together and toward what they add themselves: nothing.
The fitted weights (one vector of BUCKETS floats, 1 MB) are broadcast and a batch is scored in numpy.

Defined cases: a null, empty or blank text scores as the intercept says. Without labels of both classes the score is the prior
(0 without labels). Ids may repeat; a label counts for every row of its id; conflicting labels of one id count as toxic; null labels don't count. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import held_out, ship, table

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
FEATURES = 4096
#: Expected number of labelled rows that the model is fitted on.
TRAIN_ROWS = 20_000
LAMBDA, RIDGE = 5.0, 1e-3
#: Groups of identity terms that can stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "deaf", "blind", "elderly"),
)
SOLID = textkit.byte_table((48, 57), (65, 90), (97, 122), (0x80, 0xFF))
_SWAPS = {term: [x for x in group if x != term] for group in IDENTITY for term in group}
_TERM = re.compile(r"\b(" + "|".join(_SWAPS) + r")\b", re.I)
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(column: pa.Array):
    """(first row, number of rows, row of each hit, its bucket) by runs; a word gives itself and its beginnings."""
    for first, data, offsets in textkit.runs(column):
        low = textkit.LOWER[data]
        starts, ends, at = textkit.words(low, offsets, SOLID)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        if not len(starts):
            continue
        sums = textkit.prefix_sums(low)
        rows, buckets = [row], [textkit.span_hash(sums, starts, ends) & np.uint64(BUCKETS - 1)]
        for k in PREFIXES:
            long = ends - starts > k
            rows.append(row[long])
            buckets.append(textkit.mix(textkit.span_hash(sums, starts[long], starts[long] + k) + np.uint64(k)) & np.uint64(BUCKETS - 1))
        yield first, len(offsets) - 1, np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def _present(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * BUCKETS + buckets)
    return both // BUCKETS, both % BUCKETS


def _frequencies(batches):
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for first, _, rows, buckets in features(batch.column(0)):
            rows, buckets = _present(rows, buckets)
            mark = toxic[first + rows].astype(np.int64)
            total += np.bincount(mark * BUCKETS + buckets, minlength=2 * BUCKETS).reshape(2, BUCKETS)
    found = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[0][found]), pa.array(total[1][found])], ["bucket", "clean", "toxic"])


def mentions(text: str) -> list[tuple[str, list[str]]]:
    """(sentence, its identity terms in lower case) of every sentence that has one."""
    found = ((x, [m.lower() for m in _TERM.findall(x) if m.isascii()]) for x in _SENTENCE.findall(text)) if _TERM.search(text) else ()
    return [(x, terms) for x, terms in found if terms]


def _reduced(batches, chosen: np.ndarray):
    """Per training text its chosen features; per counterfactual pair the chosen features of one sentence alone, and of the other alone."""
    flag = np.zeros(BUCKETS, bool)
    flag[chosen] = True

    def held(texts) -> list[Counter]:
        out = [Counter() for _ in range(len(texts))]
        for first, _, rows, buckets in features(texts):
            some = flag[buckets]
            both, n = np.unique(rows[some] * BUCKETS + buckets[some], return_counts=True)
            for r, b, k in zip(both // BUCKETS, both % BUCKETS, n, strict=True):
                out[first + r][int(b)] = int(k)
        return out

    own = dict(zip(_SWAPS, held(pa.array(list(_SWAPS), pa.string())), strict=True))
    for batch in batches:
        toxic, texts = batch.column(1).to_pylist(), batch.column(0)
        pairs = Counter()
        for text in texts.to_pylist():
            said = mentions(text or "")
            for (_, terms), all_ in zip(said, held(pa.array([x for x, _ in said], pa.string())), strict=True):
                for term, n in Counter(terms).items():
                    # features of the term and of the swapped one that the rest of the sentence doesn't hold
                    alone = {b for b, k in own[term].items() if all_[b] <= k}
                    for other in _SWAPS[term]:
                        fresh = {b for b in own[other] if b not in all_}
                        pairs[tuple(sorted(alone - own[other].keys())), tuple(sorted(fresh))] += n
        kept = [sorted(x) for x in held(texts)]
        a, b = [list(p[0]) for p in pairs], [list(p[1]) for p in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(toxic + [None] * len(a), pa.int32()), pa.array(kept + a, pa.list_(pa.int32())), pa.array([[]] * len(kept) + b, pa.list_(pa.int32())), pa.array([1] * len(kept) + list(pairs.values()), pa.int64())], ["toxic", "a", "b", "n"])


def _matrix(lists: list, place: dict):
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    cols = np.array([place[b] for x in lists for b in x], np.int64)
    return rows, cols


def _fit(texts, toxic, pairs, weight, place, strength: float, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Nesterov descent on log loss + ridge + strength * mean squared change of the logit under swaps; weight says how often each pair occurs."""
    n, m, k = len(texts), len(pairs), len(place)
    push = 2 * strength * np.array(weight, float) / max(1, sum(weight))
    r, c = _matrix(texts, place)
    ra, ca = _matrix([p[0] for p in pairs], place)
    rb, cb = _matrix([p[1] for p in pairs], place)
    y = np.array(toxic, float)
    per_class = np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1)))
    w, bias = np.zeros(k), 0.0
    v, vb = w.copy(), bias
    # the largest curvature, by power iteration on a bound of the Hessian, gives the step
    probe, curve = np.random.default_rng(0).normal(size=k + 1), 1.0
    for _ in range(30):
        probe /= max(np.linalg.norm(probe), 1e-12)
        h = 0.25 * per_class * (np.bincount(r, probe[c], n) + probe[k]) / n
        out = np.append(np.bincount(c, h[r], k) + RIDGE * probe[:k], h.sum())
        if m:
            d = (np.bincount(ra, probe[ca], m) - np.bincount(rb, probe[cb], m)) * push
            out[:k] += np.bincount(ca, d[ra], k) - np.bincount(cb, d[rb], k)
        curve, probe = float(np.linalg.norm(out)), out
    rate = 1 / (1.1 * curve)
    for step in range(steps):
        z = np.bincount(r, v[c], n) + vb
        g = per_class * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        gw = np.bincount(c, g[r], k) + RIDGE * v
        if m:
            d = (np.bincount(ra, v[ca], m) - np.bincount(rb, v[cb], m)) * push
            gw += np.bincount(ca, d[ra], k) - np.bincount(cb, d[rb], k)
        new, newb = v - rate * gw, vb - rate * g.sum()
        momentum = step / (step + 3)
        v, vb = new + momentum * (new - w), newb + momentum * (newb - bias)
        w, bias = new, newb
    return w, bias


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, strength: float = LAMBDA) -> ToxicityModel:
    """labelled has text and toxic (0 or 1) of about train_rows rows at most, and nothing else is read."""
    ship(labelled.sparkSession)
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, bad = counts.get(0, 0), counts.get(1, 0)
    if not clean or not bad:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log((bad + 1e-9) / (clean + 1e-9)) if clean or bad else -35.0))
    freq = labelled.select("text", "toxic").mapInArrow(_frequencies, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").cast("double").alias("c"), F.sum("toxic").cast("double").alias("t"))
    n = float(clean + bad)
    expected = (F.col("c") + F.col("t")) * bad / n
    chi = (F.col("t") - expected) * (F.col("t") - expected) / (expected * (1 - (F.col("c") + F.col("t")) / n) + 0.5)
    chosen = [r["bucket"] for r in freq.where("c + t >= 3").orderBy(chi.desc(), "bucket").limit(FEATURES).collect()]
    reduced = labelled.select("text", "toxic").mapInArrow(lambda b: _reduced(b, np.array(chosen, np.int64)), "toxic int, a array<int>, b array<int>, n long")
    # texts as they are, FEATURES numbers each at most; of pairs the distinct ones, which the terms bound
    rows = reduced.groupBy("toxic", "a", "b").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    rows = sorted(zip(rows["a"], rows["b"], rows["toxic"], rows["n"], strict=True), key=lambda x: (x[2] is None, *x))
    texts = [(a, t) for a, _, t, n in rows if t is not None for _ in range(n)]
    pairs = [(a, b, n) for a, b, t, n in rows if t is None]
    place = {b: i for i, b in enumerate(chosen)}
    w, bias = _fit([a for a, _ in texts], [t for _, t in texts], [p[:2] for p in pairs], [p[2] for p in pairs], place, strength)
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w
    return ToxicityModel(weights, float(bias))


def _score(batches, model: ToxicityModel):
    for batch in batches:
        z = np.full(batch.num_rows, model.bias)
        for first, n, rows, buckets in features(batch.column(batch.num_columns - 1)):
            some = model.weights[buckets] != 0
            rows, buckets = _present(rows[some], buckets[some])
            z[first : first + n] += np.bincount(rows, model.weights[buckets], n)
        score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(lambda b: _score(b, shared.value), "doc_id long, held_out boolean, score double, predicted int")


def labelled_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of about train_rows labelled rows that aren't held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, train_rows / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(round(share * 1_000_003)))
    # expected size train_rows, of two numbers each: a bounded side
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(labelled_rows(docs, table(spark, sf_dir, "labels"))))
