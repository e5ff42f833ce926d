"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, components.

Texts of equal shingle sets form a class; classes are the nodes that are compared, and each is named by its smallest doc_id at the end. BANDS
bands of ROWS minima put classes into buckets (a pair of similarity 0.8 shares none with probability (1 - 0.8**5)**32 = 3e-6). A bucket
doesn't emit all its pairs: its members are compared with one leader, and the links found are closed into components. A pair with
its leader is dropped if the signatures agree in fewer than SIGNATURE_FLOOR of the minima (over six standard deviations below 0.8), and linked
only if the full sets confirm it. Members of a bucket that are still in different components are then compared by their full
sets, in blocks of at most about BLOCK members and QUERIES queries, and only links become rows.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are kept. A text of one word
has that word as its only shingle. A result's node is a doc_id: rows that repeat an id each come out, with the id's component,
and a link of any of their texts counts. A null id is linked with nothing, its component is null and it is kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import Scratch, join_one, ship, table
from .components import components

BANDS, ROWS = 32, 5
SIGNATURE_FLOOR = 0.6
PERCENT = 80
#: Bits of the filter of documents whose sets are needed; its 8 MB are all that is broadcast.
FILTER_BITS = 1 << 26
#: Members of a component or bucket that one task compares with its queries.
BLOCK = 512
#: Documents that ask one block in one task.
QUERIES = 4096
_rng = np.random.default_rng(20240229)
A = (_rng.integers(0, 1 << 31, BANDS * ROWS, np.uint64) * 2 + 1).astype(np.uint32)
B = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, width: int):
    """(row, sorted distinct 64-bit shingle hashes) of every text that has a word."""
    for first, data, offsets in textkit.runs(column):
        low = textkit.LOWER[data]
        starts, ends, at = textkit.words(low, offsets)
        if not len(starts):
            continue
        hashes = textkit.span_hash(textkit.prefix_sums(low), starts, ends)
        rolled = np.zeros(len(hashes), np.uint64)
        for k in range(width):
            shifted = np.zeros(len(hashes), np.uint64)
            shifted[: max(0, len(hashes) - k)] = hashes[k:]
            rolled = textkit.mix(rolled * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(k + 1))
        for d in np.flatnonzero(np.diff(at) > 0):
            a, b = at[d], at[d + 1]
            if b - a < width:  # the whole sequence is one shingle, unlike any full one
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = textkit.mix(np.array([whole], np.uint64) * np.uint64(0x100000001B3) ^ h)[0]
                yield first + d, np.array([whole], np.uint64)
            else:
                yield first + d, np.unique(rolled[a : b - width + 1])


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (A[:, None] * x[None, i : i + 4096] + B[:, None]).min(axis=1), out=out)
    return out


def _sign(batches, width: int):
    for batch in batches:
        n, k1, k2 = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        sigs: list = [None] * batch.num_rows
        bands = np.zeros((batch.num_rows, BANDS), np.uint64)
        for row, s in shingle_sets(batch.column(1), width):
            n[row] = len(s)
            k1[row], k2[row] = _keys(s)
            low = minima(s)
            sigs[row] = ((low * np.uint32(2654435769)) >> np.uint32(16)).astype(np.uint16).tobytes()
            key = np.arange(BANDS, dtype=np.uint64)
            for column in low.reshape(BANDS, ROWS).T:
                key = textkit.mix(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
            bands[row] = key
        flat = pa.array(bands.reshape(-1).view(np.int64))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * BANDS + 1, BANDS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(k1), pa.array(k2), listed, pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])


def _agree(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((a == b).mean(1) >= SIGNATURE_FLOOR))


def _keys(s: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two sums of mixed hashes: with the size they name a set."""
    return textkit.mix(s).sum(dtype=np.uint64).astype(np.int64), textkit.mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64)


def _sets(batches, width: int, bits: bytes):
    """doc_id, n_shingles, k1, k2 and shingles of the texts whose id the filter holds."""
    flags = np.frombuffer(bits, np.uint8)
    for batch in batches:
        at = _spot(batch.column(0).cast(pa.int64()).fill_null(-1).to_numpy())
        some = batch.filter(pa.array((flags[at >> 3] >> (at & 7)) & 1 == 1))
        n, k1, k2 = np.zeros((3, some.num_rows), np.int64)
        sets: list = [None] * some.num_rows
        for row, s in shingle_sets(some.column(1), width):
            sets[row], n[row] = s.tobytes(), len(s)
            k1[row], k2[row] = _keys(s)
        step = 512
        for i in range(0, some.num_rows, step):
            part = slice(i, i + step)
            yield pa.RecordBatch.from_arrays([some.column(0).slice(i, step), pa.array(n[part]), pa.array(k1[part]), pa.array(k2[part]), pa.array(sets[part], pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "shingles"])


def _spot(ids: np.ndarray) -> np.ndarray:
    return (textkit.mix(ids.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_parts(batches):
    found: set[int] = set()
    for batch in batches:
        for x in _spot(batch.column(0).to_numpy()):
            found.add(int(x))
    at = np.array(sorted(found), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 32767)], ["part", "bit"])


def _confirm(batches, percent: int):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                keep.append(False)
                continue
            both = np.concatenate([a, b])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            keep.append(100 * inter >= percent * (len(a) + len(b) - inter))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _links_between(queries: list, members: list, percent: int) -> np.ndarray:
    """(query, member) places of the pairs similar enough; one sorted list of the members' shingles is searched by each query."""
    sets = [np.frombuffer(x, np.uint64) for x in members]
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
    found = [np.zeros((0, 2), np.int64)]
    for i, q in enumerate(queries):
        q = np.frombuffer(q, np.uint64)
        lo, hi = np.searchsorted(every, q), np.searchsorted(every, q, "right")
        runs = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        inter = np.bincount(owner[at], minlength=len(sets))
        hit = np.flatnonzero(100 * inter >= percent * (len(q) + sizes - inter))
        found.append(np.stack([np.full(len(hit), i), hit], 1))
    return np.concatenate(found)


def _rows(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _against(block: pa.Table, percent: int) -> pa.Table:
    """A block of a component's members, and documents of other components that ask: a link of each that has one."""
    asks = block.column("asks").combine_chunks()
    left, right = block.filter(pc.invert(asks)), block.filter(asks)
    members, queries = left.column("rep").to_pylist(), right.column("rep").to_pylist()
    if not members or not queries:
        return pa.Table.from_batches([_rows([], [])])
    hit = _links_between(right.column("shingles").to_pylist(), left.column("shingles").to_pylist(), percent)
    hit = hit[np.unique(hit[:, 0], return_index=True)[1]]
    return pa.Table.from_batches([_rows([members[m] for _, m in hit], [queries[q] for q, _ in hit])])


def _among(block: pa.Table, percent: int) -> pa.Table:
    """Documents of a bucket that are alone in their components: the links between them, or between two blocks of them."""
    ids, sets, side = (block.column(c).to_pylist() for c in ("rep", "shingles", "side"))
    hit = _links_between(sets, sets, percent)
    hit = [(a, b) for a, b in hit.tolist() if a < b and (side[a] != side[b] or side[a] == 0)]
    return pa.Table.from_batches([_rows([ids[a] for a, _ in hit], [ids[b] for _, b in hit])])


def _residual(held: DataFrame, part: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame | None:
    """Links between classes that share a bucket but not yet a component.

    held has bucket and rep. Members of the smaller component are compared with all of the larger one, a block of BLOCK
    members with a block of QUERIES of those that ask; classes that are alone in their components with each other inside their bucket, in pairs of
    blocks. No pair becomes a row unless it is a link.
    """
    named = held.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    named = scratch.keep(named, "named")
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    named = scratch.keep(join_one(named, mixed, "bucket", scratch, "left_semi"), "held")
    if not named.limit(1).count():
        return None
    sizes = scratch.keep(part.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    present = scratch.keep(named.select("bucket", "component").distinct(), "pairs")
    present = scratch.keep(join_one(present, sizes, "component", scratch, "left").select("bucket", "component", F.coalesce("size", F.lit(1)).alias("size")), "present")
    big = present.where("size > 1").select("bucket", F.col("component").alias("large"), F.col("size").alias("large_size"))
    smaller = (F.col("size") < F.col("large_size")) | ((F.col("size") == F.col("large_size")) & (F.col("component") > F.col("large")))
    among = present.join(big, "bucket").where(smaller & (F.col("component") != F.col("large"))).select("component", "size", "large").distinct()
    among = scratch.keep(among, "among")
    everyone = scratch.keep(part.select(F.col("node").alias("rep"), "component").unionByName(named.select("rep", "component")).distinct(), "everyone")
    needed = among.select("component").unionByName(among.select(F.col("large").alias("component"))).unionByName(present.where("size = 1").select("component")).distinct()
    wanted = scratch.keep(join_one(everyone, needed, "component", scratch, "left_semi"), "wanted")
    sets = _sets_of(wanted.select(F.col("rep").alias("node")), classes, docs, scratch, width)
    sets = scratch.keep(wanted.join(sets.withColumnRenamed("node", "rep"), "rep").select("rep", "component", "shingles"), "held_sets")
    blocks = lambda n, most: F.greatest(F.ceil(n / most), F.lit(1)).cast("long")
    asked = among.groupBy(F.col("large").alias("component")).agg(F.sum("size").alias("asks")).join(sizes, "component")
    asked = scratch.keep(asked.select("component", blocks(F.col("size"), BLOCK).alias("blocks"), blocks(F.col("asks"), QUERIES).alias("turns")), "asked")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = join_one(sets, asked, "component", scratch).select("component", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), every("turns").alias("turn"), "rep", "shingles")
    # a hot component asks only larger ones, of which there are as few
    asking = among.select("component", "large").join(asked.withColumnRenamed("component", "large"), "large")
    queries = join_one(sets, asking, "component", scratch).withColumn("turn", F.pmod(F.xxhash64("rep"), "turns")).select(F.col("large").alias("component"), every("blocks").alias("block"), "turn", "rep", "shingles")
    both = members.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    first = both.groupBy("component", "block", "turn").applyInArrow(lambda t: _against(t, percent), "a long, b long")
    alone = scratch.keep(join_one(named, sizes, "component", scratch, "left_anti").select("bucket", "rep"), "alone")
    counts = alone.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").withColumn("blocks", F.ceil(F.col("k") / BLOCK))
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks"))
    alone = join_one(alone, counts, "bucket", scratch).withColumn("own", own).withColumn("other", every("blocks"))
    # side: 0 of a block by itself, 1 and 2 the two blocks of a pair
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    alone = alone.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "rep")
    second = alone.join(sets.select("rep", "shingles"), "rep").groupBy("bucket", "x", "y").applyInArrow(lambda t: _among(t, percent), "a long, b long")
    return scratch.keep(first.unionByName(second).distinct(), "links")


def _bits(ids: DataFrame) -> bytes:
    """The filter's bits as bytes: at most FILTER_BITS / 8, whatever the number of ids, so they come in one job and not in one for each partition."""
    parts = ids.mapInArrow(_filter_parts, "part int, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("b"))
    out = bytearray(FILTER_BITS // 8)
    for r in parts.collect():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = bytes(r["b"])
    return bytes(out)


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """node and shingles (sorted hashes as bytes) of the classes named."""
    keys = ["doc_id", "n_shingles", "k1", "k2"]
    named = classes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), *keys[1:])
    named = scratch.keep(named, "ids")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(named.select("doc_id")))
    sets = docs.select("doc_id", "text").mapInArrow(lambda x: _sets(x, width, bits.value), "doc_id long, n_shingles long, k1 long, k2 long, shingles binary").where("shingles is not null")
    sets = scratch.keep(sets.join(named, keys).groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")
    bits.destroy()
    return sets


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose full sets are similar enough; a leads many pairs."""
    named = lambda rows, column: (rows.select(F.col("node").alias("a"), F.col(column).alias("sa")), rows.select(F.col("node").alias("b"), F.col(column).alias("sb")))
    a, b = named(classes, "sig")
    near = join_one(scratch.keep(pairs.distinct(), "leads"), a, "a", scratch).join(b, "b").select("a", "b", "sa", "sb")
    near = scratch.keep(near.mapInArrow(_agree, "a long, b long"), "near")
    a, b = named(_sets_of(near.select(F.explode(F.array("a", "b")).alias("node")), classes, docs, scratch, width), "shingles")
    joined = join_one(near, a, "a", scratch).join(b, "b").select("a", "b", "sa", "sb")
    found = scratch.keep(joined.mapInArrow(lambda x: _confirm(x, percent), "a long, b long"), "links")
    scratch.drop("sets")
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs, which has doc_id and text."""
    spark = ship(docs.sparkSession)
    scratch = scratch or Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(docs.mapInArrow(lambda b: _sign(b, width), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary"), "signed")
    keys = ["k1", "k2", "n_shingles"]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    # rows of a class have one set, so their bands and signatures are alike; written once, the nodes' numbers stay
    classes = usable.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = classes.select(F.col("node").alias("rep"), F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count("*").alias("n")).where("a < z")
    full = scratch.keep(full.select("bucket", "a", "n", F.col("n").alias("rows")), "full")
    buckets = scratch.keep(join_one(buckets, full, "bucket", scratch, counted="rows"), "buckets")
    links = _verified(buckets.where("rep <> a").select("a", F.col("rep").alias("b")), classes, docs, scratch, width, percent)
    part = scratch.keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "part")
    rest = _residual(buckets.where("n > 2").select("bucket", "rep"), part, classes, docs, scratch, width, percent)
    if rest is not None:
        links = scratch.keep(links.unionByName(rest), "links")
    # from nodes to ids: the smallest id of a class stands for it, and its other ids hang on it
    member = join_one(scratch.keep(usable.select(*keys, "doc_id").distinct().withColumn("k", F.struct(*keys)).select("k", "doc_id"), "members"), classes.where("size > 1").select(F.struct(*keys).alias("k"), "rep"), "k", scratch)
    u, v = (classes.select(F.col("node").alias(x), F.col("rep").alias(y)) for x, y in (("a", "u"), ("b", "v")))
    edges = join_one(links, u, "a", scratch).join(v, "b").select("u", "v").unionByName(member.where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    part = components(edges, scratch).select(F.col("node").alias("doc_id"), "component")
    out = signed.select("doc_id", "n_shingles").join(part, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP8_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE [ws[i], ws[i + 1]] END AS sh
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 1 THEN [1] ELSE range(1, len(ws)) END) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 80 * (na.n + nb.n - p.i)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
