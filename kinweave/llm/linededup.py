"""Line dedup by a deletion-neighbourhood join: of lines within the edit bound of each other the earliest stays.

A line is its words (runs of non-blanks); the bound is one word inserted, deleted or replaced where both lines have
MIN_WORDS words or more, and none for shorter lines, which only go if they are equal. Order is (doc_id, line number). A line goes
if an equal line comes earlier, or if it is its text's first occurrence and a line within the bound comes earlier.

Equal lines are collapsed first by pre-aggregation. One edit leaves the first or the last half untouched, so only distinct lines
that share a half with a line of a fitting length can have a partner; halves are compared by hash, pre-aggregated, and only such lines emit
their neighbourhood: the line without each word in the half that may differ. Variants are keyed so that equality
decides: a replaced word by its place and the rest, an inserted one by the longer line's rest and the shorter line. Each variant's lines
are joined with its earliest ones, pre-aggregated, never with each other; the edit distance is then verified on the words.

Defined cases: null and empty texts have no lines; blank lines are counted and stay. There is one row for each distinct doc_id; rows that
repeat it are one document, whose equal lines of one number are one line. A null id comes last. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import Scratch, ship, table

MIN_WORDS = 10
#: Bits of the filter of lines whose words are needed; its 16 MB are all that is broadcast.
FILTER_BITS = 1 << 27
#: What a line may emit: places of a replaced word in its last half (1) or first half (2), as the longer (4) or the shorter one (8).
TAIL, HEAD, LONGER, SHORTER = 1, 2, 4, 8
LAST_ID = (1 << 63) - 1
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _sums(hashes: np.ndarray) -> np.ndarray:
    up, _ = textkit.powers(len(hashes) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])


def _span(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the words a to b, the same wherever they stand."""
    _, down = textkit.powers(len(sums))
    return textkit.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def line_words(texts: pa.Array):
    """By runs: document row and number of each line that has a word, hashes of all words, first and last word of each line."""
    for first, data, offsets in textkit.runs(texts):
        breaks = np.flatnonzero(data == 10) + 1
        begins = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]]))
        starts, ends, _ = textkit.words(data, offsets)
        if not len(starts):
            continue
        hashes = textkit.span_hash(textkit.prefix_sums(data), starts, ends)
        doc = np.searchsorted(offsets, begins, "right") - 1
        number = np.arange(len(begins)) - np.searchsorted(begins, offsets[:-1])[doc]
        at = np.searchsorted(starts, np.concatenate([begins, [len(data)]]))
        some = at[1:] > at[:-1]
        yield first + doc[some], number[some], hashes, at[:-1][some], at[1:][some]


def _half(sums, a, b, side: int, shorter: np.ndarray, kind: int) -> np.ndarray:
    t = shorter // 2
    half = _span(sums, a, a + t) if side == 1 else _span(sums, b - t, b)
    return textkit.mix(half + textkit.mix(shorter.astype(np.uint64) * np.uint64(8) + np.uint64(side + 2 * kind)) * _SALT)


def _lines(batches):
    """Every line with a word: doc_id, line, key of its words, and hashes of its halves (null for lines below MIN_WORDS)."""
    for batch in batches:
        for rows, number, hashes, a, b in line_words(batch.column(1)):
            sums, n = _sums(hashes), b - a
            halves = []
            for kind, shorter in ((0, n), (1, n - 1), (1, n)):  # as a line of equal length; as the longer; as the shorter one
                halves += [pa.array(_half(sums, a, b, side, shorter, kind).view(np.int64), mask=(n < MIN_WORDS) | (shorter < MIN_WORDS)) for side in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(number.astype(np.int64)), pa.array(_span(sums, a, b).view(np.int64)), *halves], ["doc_id", "line", "key", "s1", "s2", "l1", "l2", "h1", "h2"])


def _spot(keys: np.ndarray) -> np.ndarray:
    return (textkit.mix(keys.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_parts(batches):
    for batch in batches:
        at = np.unique(_spot(batch.column(0).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 32767)], ["part", "bit"])


def _bits(keys: DataFrame) -> bytes:
    parts = keys.mapInArrow(_filter_parts, "part int, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("b"))
    out = bytearray(FILTER_BITS // 8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = bytes(r["b"])
    return bytes(out)


def _live_words(batches, bits: bytes):
    flags = np.frombuffer(bits, np.uint8)
    for batch in batches:
        for _rows, _number, hashes, a, b in line_words(batch.column(0)):
            key = _span(_sums(hashes), a, b)
            spot = _spot(key.view(np.int64))
            live = np.flatnonzero(((flags[spot >> 3] >> (spot & 7)) & 1 == 1) & (b - a >= MIN_WORDS))
            live = live[np.unique(key[live], return_index=True)[1]]
            if len(live):
                sizes = (b - a)[live]
                index = np.concatenate([np.arange(a[i], b[i]) for i in live])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes[index].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key[live].view(np.int64)), lists], ["key", "ws"])


def _variants(batches):
    """(variant, longer, key, doc_id, line) of the live lines; longer is null for replaced words."""
    names = ["variant", "longer", "key", "doc_id", "line"]
    for batch in batches:
        keys, masks, ids, lines = (batch.column(c).to_numpy() for c in range(4))
        out: list[list] = [[], [], []]
        for i in range(batch.num_rows):
            hashes = batch.column(4)[i].values.to_numpy().view(np.uint64)
            n, sums = len(hashes), _sums(hashes)
            k = np.arange(n)
            rest = sums[k] + (sums[n] - sums[k + 1]) * textkit.powers(n + 1)[1][1]  # the words after k move one place down
            t = n // 2
            place = k[(k >= t) * bool(masks[i] & TAIL) | (k < n - t) * bool(masks[i] & HEAD)]
            found = [(textkit.mix(rest[place] + textkit.mix(place.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(n))), -1)]
            if masks[i] & LONGER:
                found.append((np.unique(textkit.mix(rest + np.uint64(n - 1))), 1))
            if masks[i] & SHORTER:
                found.append((textkit.mix(sums[n:] + np.uint64(n)), 0))
            for variant, role in found:
                out[0].append(variant)
                out[1].append(np.full(len(variant), role, np.int8))
                out[2].append(np.full(len(variant), i))
        variant, role, row = (np.concatenate(x) for x in out)
        yield pa.RecordBatch.from_arrays([pa.array(variant.view(np.int64)), pa.array(role == 1, mask=role < 0), pa.array(keys[row]), pa.array(ids[row]), pa.array(lines[row])], names)


def _one_edit(x: np.ndarray, y: np.ndarray) -> bool:
    short, long = min(len(x), len(y)), max(len(x), len(y))
    if long - short > 1:
        return False
    front = x[:short] == y[:short]
    back = (x[len(x) - short :] == y[len(y) - short :])[::-1]
    return sum(short if same.all() else int(same.argmin()) for same in (front, back)) >= long - 1


def _verify(batches):
    for batch in batches:
        ok = [_one_edit(batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()) for i in range(batch.num_rows)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def drops(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id (null as LAST_ID), line and near (an equal line is earlier: false; else true) of each line that goes; docs has doc_id and text."""
    spark = ship(docs.sparkSession)
    scratch = scratch or Scratch(spark, "lines")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "text")
    lines = scratch.keep(docs.mapInArrow(_lines, "doc_id long, line long, key long, s1 long, s2 long, l1 long, l2 long, h1 long, h2 long"), "lines")
    first = F.min(F.struct("doc_id", "line")).alias("first")
    classes = scratch.keep(lines.groupBy("key").agg(first, F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("s1", "s2", "l1", "l2", "h1", "h2")]), "classes")
    # a half of one hash is shared by lines of one length (s), or by a longer and a shorter line (l, h)
    kinds = (("s1", TAIL, 0), ("s2", HEAD, 0), ("l1", LONGER, 1), ("l2", LONGER, 1), ("h1", SHORTER, 2), ("h2", SHORTER, 2))
    halves = classes.select("key", F.explode(F.array(*[F.struct(F.col(c).alias("half"), F.lit(m).alias("mask"), F.lit(k).alias("kind")) for c, m, k in kinds])).alias("e")).select("key", "e.*").where("half is not null")
    shared = halves.groupBy("half").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.min("kind").alias("x"), F.max("kind").alias("y")).where("a < z and (y = 0 or x < y)").select("half")
    live = halves.join(shared, "half", "left_semi").groupBy("key").agg(F.bit_or("mask").alias("mask"))
    live = scratch.keep(live.join(classes.select("key", "first"), "key").select("key", "mask", "first.doc_id", "first.line"), "live")
    bits = spark.sparkContext.broadcast(_bits(live.select("key")))
    words = docs.select("text").mapInArrow(lambda b: _live_words(b, bits.value), "key long, ws array<long>")
    words = scratch.keep(words.join(live.select("key"), "key", "left_semi").dropDuplicates(["key"]), "words")
    named = live.join(words, "key").select("key", "mask", "doc_id", "line", "ws")
    near = scratch.keep(named.mapInArrow(_variants, "variant long, longer boolean, key long, doc_id long, line long"), "variants")
    who = F.struct("doc_id", "line", "key")
    earliest = near.groupBy("variant").agg(F.min(who).alias("any"), F.min(F.when(F.col("longer"), who)).alias("long"), F.min(F.when(~F.col("longer"), who)).alias("short"), F.max("key").alias("z"), F.min("key").alias("a")).where("a < z").select("variant", "any", "long", "short")
    # a replaced word's partner is any line of the variant; else a longer line's is the shorter one and the other way round
    partner = F.when(F.col("longer").isNull(), F.col("any")).when(F.col("longer"), F.col("short")).otherwise(F.col("long"))
    pairs = near.join(earliest, "variant").withColumn("p", partner).where(F.struct("p.doc_id", "p.line") < F.struct("doc_id", "line")).select("key", F.col("p.key").alias("partner")).distinct()
    sides = pairs.join(words.withColumnRenamed("ws", "wa"), "key").join(words.select(F.col("key").alias("partner"), F.col("ws").alias("wb")), "partner").select("key", "partner", "wa", "wb")
    gone = scratch.keep(sides.mapInArrow(_verify, "key long, partner long").select("key").distinct().withColumn("gone", F.lit(True)), "gone")
    state = classes.where("n > 1").select("key", "first").join(gone, "key", "full").join(classes.select("key", F.col("first").alias("f")), "key").select("key", "f", F.coalesce("gone", F.lit(False)).alias("gone"))
    again = F.struct(F.col("doc_id"), F.col("line")) > F.col("f")
    return scratch.keep(lines.select("doc_id", "line", "key").join(state, "key").where(again | F.col("gone")).select("doc_id", "line", (~again).alias("near")).distinct(), "drops")


def dedup_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_lines, n_equal and n_near (lines that go as equal and as near ones) of every document."""
    gone = drops(docs, scratch).groupBy("doc_id").agg(F.count_if(~F.col("near")).alias("e"), F.count_if("near").alias("r"))
    sizes = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).alias("lines")).groupBy("doc_id").agg(F.sum("lines").alias("n_lines"))
    out = sizes.join(gone, "doc_id", "left")
    return out.select(F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")).alias("doc_id"), "n_lines", F.coalesce("e", F.lit(0)).cast("long").alias("n_equal"), F.coalesce("r", F.lit(0)).cast("long").alias("n_near"))


def clean(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text and more) without the lines that go."""
    gone = drops(docs, scratch).groupBy("doc_id").agg(F.collect_set("line").alias("__gone")).withColumnRenamed("doc_id", "__id")
    out = docs.join(gone, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)) == F.col("__id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("__gone", i.cast("long"))), "\n")
    return out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).drop("__gone", "__id")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE length(text) > 0),
a AS MATERIALIZED (SELECT doc_id, i - 1 AS line, regexp_extract_all(parts[i], '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)),
l AS MATERIALIZED (SELECT doc_id, line, ws, array_to_string(ws, ' ') AS k FROM a WHERE len(ws) > 0),
c AS MATERIALIZED (SELECT k, any_value(ws) AS ws, min((doc_id, line)) AS f FROM l GROUP BY k),
v AS MATERIALIZED (SELECT k, f, n, i, array_to_string(ws[1 : i - 1] || ws[i + 1 : n], ' ') AS r FROM (SELECT k, f, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM c WHERE len(ws) >= 10)),
s AS (SELECT n, i, r, min(f) AS m FROM v GROUP BY ALL HAVING count(*) > 1),
g AS (
  SELECT v.k FROM v JOIN s ON v.n = s.n AND v.i = s.i AND v.r = s.r WHERE s.m < v.f
  UNION SELECT v.k FROM v JOIN c ON v.r = c.k WHERE v.n > 10 AND c.f < v.f
  UNION SELECT c.k FROM v JOIN c ON v.r = c.k WHERE v.n > 10 AND v.f < c.f
),
o AS (SELECT l.doc_id, count(*) FILTER ((l.doc_id, l.line) > c.f) AS e, count(*) FILTER ((l.doc_id, l.line) = c.f AND g.k IS NOT NULL) AS r FROM l JOIN c ON l.k = c.k LEFT JOIN g ON g.k = l.k GROUP BY 1)
SELECT d.doc_id, sum(CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END)::BIGINT AS n_lines, coalesce(any_value(o.e), 0)::BIGINT AS n_equal, coalesce(any_value(o.r), 0)::BIGINT AS n_near
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id
"""
