"""Spelling variant grouping by rolling-hash deletions.

Words are counted per task in Arrow and summed by word. For every word of the vocabulary, prefix and suffix polynomial hashes of its code
points give, in numpy, the hash of the word without each of its code points. Such keys are dealt by their top bits into radix partitions,
whose number follows the number of keys, and sorted there; only keys that occur again live on. A replaced code point is a pair of keys of equal place and rest, an inserted one the
longer word's key and the shorter word's own. What the hashes found is verified on the strings: groups and joins go by the
rests themselves. Words of one place and rest differ in one code point, so a group holds an alphabet (90 letters) at most; no other group is gathered.

A word's form is its near word of largest n, if that is FACTOR times its own; the root follows forms to the last by pointer doubling.
Counts grow by FACTOR along a chain, so some five rounds are enough.

Defined cases: null and empty texts have no words. A null doc_id is written as nothing before the colon. Rows that repeat an id, or are equal,
count each. Runs may have any length. Ties between near words go to the smallest in code-point order. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import Scratch, join_one, numbered, ship, table

MIN_LENGTH = 7
MIN_COUNT = 2
FACTOR = 10
DIVISOR = 31
#: Keys in a radix partition, about.
RADIX_ROWS = 1 << 17
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000
#: Runs above so many bytes get their CRC-32 one by one.
LONG = 64
REPLACED, DELETED, WHOLE = 0, 1, 2
_LETTER = textkit.byte_table((65, 90), (97, 122))
_SALT = np.uint64(0x9E3779B97F4A7C15)


@cache
def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, carried on from the CRC-32 of what stands before it; one step for each place, not for each word."""
    sizes, out, steps = ends - starts, before.copy(), _crc_table()
    order = np.argsort(-sizes, kind="stable")
    short = order[np.searchsorted(-sizes[order], -LONG) :]
    at, state = starts[short], ~before[short]
    counts = np.searchsorted(-sizes[short], -np.arange(LONG + 1), "left")  # of spans longer than each place
    for place in range(LONG):
        n = counts[place]
        if not n:
            break
        state[:n] = steps[(state[:n] ^ data[at[:n] + place]) & 0xFF] ^ (state[:n] >> 8)
    out[short] = ~state
    for i in order[: len(order) - len(short)]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow array, without a Python object for each."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at]))


def _occurrences(ids: pa.Array, texts: pa.Array) -> Iterator[pa.Array]:
    """Results of at least MIN_LENGTH code points, an array for each run of texts."""
    prefix = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids.to_pylist()], np.uint32)
    for first, raw, offsets in textkit.runs(texts):
        data = textkit.LOWER[raw]
        high = raw == 0xC3  # with the byte that follows, a letter of the range
        solid = _LETTER[raw] | high
        solid[1:] |= high[:-1]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero(solid & ~(np.concatenate([[False], solid[:-1]]) & ~cut[:-1]))
        ends = np.flatnonzero(solid & ~(np.concatenate([solid[1:], [False]]) & ~cut[1:])) + 1
        pairs = np.concatenate([[0], np.cumsum(high)])
        length = ends - starts - (pairs[ends] - pairs[starts])
        keep = length >= MIN_LENGTH
        starts, ends, length = starts[keep], ends[keep], length[keep]
        doc = first + np.searchsorted(offsets, starts, "right") - 1
        crc = _crcs(data, starts, ends, prefix[doc])
        cut_one = crc % DIVISOR == 0
        yield _strings(data, starts[~cut_one], ends[~cut_one])
        shorter = []
        for i in np.flatnonzero(cut_one & (length > MIN_LENGTH)):
            word, at = data[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(length[i])
            shorter.append(word[:at] + word[at + 1 :])
        yield pa.array(shorter, pa.large_string())


def _counts(batches):
    """(word, n), summed over as much of a task as HELD allows."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        for words in _occurrences(batch.column(0), batch.column(1)):
            if len(words):
                found = words.value_counts()
                held.append(pa.table([found.field(0), found.field(1)], ["word", "n"]))
            if sum(len(x) for x in held) > HELD:
                held = [summed()]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches(100_000)
    if held:
        yield from summed().to_batches(100_000)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of each distinct result that occurs MIN_COUNT times; docs has doc_id and text."""
    counts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counts, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, word's row, kind and place of all keys of a run of words; equal strings have equal keys."""
    found = []
    for first, data, offsets in textkit.runs(words):
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        up, down = textkit.powers(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mix((codes + np.uint64(1)) * _SALT) * up[: len(codes)], dtype=np.uint64)])
        size = np.diff(lead)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(codes))
        begin, end = lead[:-1][row], lead[1:][row]
        rest = ((sums[at] - sums[begin]) + (sums[end] - sums[at + 1]) * down[1]) * down[begin]
        rest = textkit.mix(rest + (size[row] - 1).astype(np.uint64))
        place = at - begin
        replaced = textkit.mix(rest ^ textkit.mix((place.astype(np.uint64) << np.uint64(32)) + size[row].astype(np.uint64) + _SALT))
        # of equal neighbours the last is enough: without any of them the word reads alike
        last = np.flatnonzero((at == end - 1) | (codes != np.concatenate([codes[1:], codes[:1]])))
        whole = textkit.mix((sums[lead[1:]] - sums[lead[:-1]]) * down[lead[:-1]] + size.astype(np.uint64))
        for keys, rows, kind, places in ((replaced, row, REPLACED, place), (rest[last], row[last], DELETED, place[last]), (whole, np.arange(len(size)), WHOLE, np.zeros(len(size), np.int64))):
            found.append((keys.view(np.int64), first + rows, np.full(len(keys), kind, np.int8), places.astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _keys(batches):
    for batch in batches:
        key, row, kind, place = deletion_keys(batch.column(1))
        for i in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), batch.column(0).take(pa.array(row[i : i + 100_000])), pa.array(kind[i : i + 100_000].astype(np.int8)), pa.array(place[i : i + 100_000].astype(np.int32))], ["key", "wid", "kind", "place"])


def _again(block: pa.Table) -> pa.Table:
    """Of one radix partition, sorted: the rows of keys that two replaced words share, or a longer and a whole word."""
    key, kind = block.column("key").to_numpy(), block.column("kind").to_numpy()
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    has = lambda k: np.add.reduceat((kind[order] == k).astype(np.int64), begins)
    live = (has(REPLACED) > 1) | ((has(DELETED) > 0) & (has(WHOLE) > 0))
    rows = order[np.repeat(live, np.diff(np.concatenate([begins, [len(order)]])))]
    return block.select(["key", "wid", "kind", "place"]).take(pa.array(rows))


def shared_keys(words: DataFrame, scratch: Scratch) -> DataFrame:
    """key, wid, kind and place of the keys that meet another word's; words has wid and word."""
    total = words.agg(F.sum(2 * F.length("word") + 1).alias("n")).first()["n"] or 0
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / RADIX_ROWS))))
    schema = "key long, wid long, kind byte, place int"
    keys = words.select("wid", "word").mapInArrow(_keys, schema)
    radix = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    return scratch.keep(keys.withColumn("radix", radix).groupBy("radix").applyInArrow(_again, schema), "shared")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """wid, n_near and best (less: its negative n, its word and wid) of the words that have a near one; words has wid, word and n."""
    who = F.struct((-F.col("n")).alias("less"), "word", "wid")
    named = shared_keys(words, scratch).join(words, "wid").withColumn("who", who)
    without = F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)"))
    named = scratch.keep(named.select("key", "kind", "place", "who", F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(without).alias("rest")), "named")
    # words that differ at one place: an alphabet at most
    groups = named.where(F.col("kind") == REPLACED).groupBy("key", "place", "rest").agg(F.sort_array(F.collect_list("who")).alias("m")).where(F.size("m") > 1)
    replaced = groups.select(F.posexplode("m").alias("i", "who"), "m").select("who.wid", (F.size("m") - 1).cast("long").alias("near"), F.when(F.col("i") == 0, F.col("m")[1]).otherwise(F.col("m")[0]).alias("best"))
    longer = named.where(F.col("kind") == DELETED).select("key", "rest", F.col("who").alias("a"))
    pairs = longer.join(named.where(F.col("kind") == WHOLE).select("key", "rest", F.col("who").alias("b")), ["key", "rest"])
    one = F.lit(1).cast("long").alias("near")
    both = replaced.unionByName(pairs.select("a.wid", one, F.col("b").alias("best"))).unionByName(pairs.select("b.wid", one, F.col("a").alias("best")))
    return both.groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """wid and root of the words that have a form, by pointer doubling; forms has wid and root (the form's wid)."""
    steps = scratch.keep(forms.select("wid", "root"), "roots")
    while True:
        onward = steps.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        steps = scratch.keep(join_one(steps, onward, "root", scratch, "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not steps.where("moved").limit(1).count():
            return steps.select("wid", "root")
        steps = steps.select("wid", "root")


def spelling_variants(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word; docs has doc_id and text."""
    spark = ship(docs.sparkSession)
    scratch = scratch or Scratch(spark, "spelling")
    words = numbered(vocabulary(docs), scratch, "wid")
    near = scratch.keep(words.join(near_words(words, scratch), "wid", "left"), "near")
    formed = F.coalesce(-F.col("best.less") >= FACTOR * F.col("n"), F.lit(False))
    near = near.withColumn("best", F.when(formed, F.col("best")))
    found = roots(near.where("best is not null").select("wid", F.col("best.wid").alias("root")), scratch)
    names = scratch.keep(join_one(found, words.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root", scratch).select("wid", "root_word"), "names")
    return near.join(names, "wid", "left").select("word", F.col("best.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.less")).alias("form_n"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS steps
),
r AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS w FROM documents
  ) WHERE length(w) >= 7 GROUP BY ALL
),
b AS (SELECT doc_id, w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r),
c AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(t.steps[(xor(c, y) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h
  FROM b, t
),
v AS MATERIALIZED (
  SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM c)
  WHERE length(w) >= 7 GROUP BY 1 HAVING sum(n) >= 2
),
d AS MATERIALIZED (SELECT w, n, length(w) AS l, i, substr(w, 1, i) || substr(w, i + 2) AS r FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
p AS MATERIALIZED (
  SELECT x.w, y.w AS o, y.n AS m FROM d x JOIN d y ON x.i = y.i AND x.l = y.l AND x.r = y.r AND x.w <> y.w
  UNION SELECT d.w, v.w, v.n FROM d JOIN v ON d.r = v.w
  UNION SELECT v.w, d.w, d.n FROM d JOIN v ON d.r = v.w
),
k AS (SELECT w, o, m, count(*) OVER (PARTITION BY w) AS c, row_number() OVER (PARTITION BY w ORDER BY m DESC, encode(o)) AS j FROM p),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(k.c, 0) AS c, CASE WHEN k.m >= 10 * v.n THEN k.o END AS form, CASE WHEN k.m >= 10 * v.n THEN k.m END AS form_n FROM v LEFT JOIN k ON k.w = v.w AND k.j = 1),
s AS (SELECT w, w AS root, 0 AS depth FROM f UNION ALL SELECT s.w, f.form, s.depth + 1 FROM s JOIN f ON f.w = s.root WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, s.root, f.n, f.c::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM f JOIN (SELECT w, arg_max(root, depth) AS root FROM s GROUP BY w) s ON s.w = f.w
"""
