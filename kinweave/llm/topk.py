"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors are dealt to shards of about SHARD rows. A shard's postings are the components of its vectors: the impact is the component's size in LEVELS
quantised steps, and postings of one impact, dimension and sign are a segment, whose rows all add the same amount to a query's score.
Segments are processed by descending impact for a batch of queries, each as one addition into the accumulators of its rows. At some stops between impacts
the index knows what is still missing from each row: the norm of the row less what its processed segments stand for, quantisation included. Query norm times this
norm bounds the missing score (Cauchy and Schwarz). The K rows with the largest accumulators are scored exactly, and their smallest score is a threshold: rows whose
accumulator plus bound lies below it are proved not to be members. When few possible members are left, or all segments are processed, the rest are
rescored exactly in integers, all of them. Ties at the threshold are possible members, so none is lost.

Every query meets every shard; a shard's index goes once to each block of some BLOCK queries, a query as one row to each shard. Of a shard K rows a query are left.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; nor do those whose squared norm as integers may reach 2**62, for 64 bits can't hold
their scores. Only vectors of equal length are compared; empty ones score 0. Rows that repeat an id are separate: each is a query of its own and a
candidate of the others. A null id is never a query; as a candidate it comes last among ties. Negative ids divisible by the divisor are queries. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, ship, table

SCALE = 256
K = 5
DIVISOR = 50
SHARD = 2048
BLOCK = 4096
LEVELS = 32
#: Queries that share accumulators.
BATCH = 512
#: Parts of a shard's postings after which a proof is tried.
STOPS = (0.6, 0.8, 0.9, 1.0)
#: Part of a batch's rows that are rescored at once.
FEW = 1 / 64
FOUND = "ask long, uid long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, integers, of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    fits = F.coalesce(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x), F.lit(0.0)) < float(1 << 62)
    return vectors.where(F.col("embedding").isNotNull() & finite).where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("v"))


class Index:
    """Segments of one shard's vectors of one length, by descending impact."""

    def __init__(self, vectors: np.ndarray, dims: np.ndarray, amounts: np.ndarray, begins: np.ndarray, rows: np.ndarray, stops: np.ndarray, missing: np.ndarray):
        self.vectors, self.dims, self.amounts, self.begins, self.rows, self.stops, self.missing = vectors, dims, amounts, begins, rows, stops, missing

    @classmethod
    def build(cls, vectors: np.ndarray) -> Index:
        n, d = vectors.shape
        step = max(1, -(-int(np.abs(vectors).max(initial=0)) // LEVELS))
        impact, dim = (np.abs(vectors) // step).ravel(), np.tile(np.arange(d), n)
        negative = (vectors < 0).ravel()
        order = np.lexsort((negative, dim, -impact))
        sort = np.stack([-impact[order], dim[order], negative[order]])
        begins = np.flatnonzero(np.concatenate([[True] * bool(order.size), (sort[:, 1:] != sort[:, :-1]).any(0)]))
        middle = impact[order][begins] * step + (step - 1) // 2
        amounts = np.where(negative[order][begins], -middle, middle)
        rows, ends = (np.arange(n).repeat(d))[order], np.append(begins[1:], order.size)
        # what the segments before each stop leave of a row
        left, stops, missing = vectors.astype(np.float64), [], []
        done = 0
        for share in STOPS:
            until = int(np.searchsorted(ends, share * order.size)) + 1 if share < 1 else len(begins)
            until = min(until, len(begins))
            for s in range(done, until):
                left[rows[begins[s] : ends[s]], dim[order[begins[s]]]] -= amounts[s]
            done = until
            stops.append(until)
            missing.append(np.sqrt(np.einsum("ij,ij->i", left, left)) * (1 + 1e-9))
        return cls(vectors, dim[order][begins], amounts, np.append(begins, order.size), rows, np.array(stops), np.array(missing))

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = np.uint16 if len(self.vectors) < 1 << 16 else np.int64
        np.savez(out, vectors=self.vectors, dims=self.dims, amounts=self.amounts, begins=self.begins, rows=self.rows.astype(small), stops=self.stops, missing=self.missing)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        z = np.load(io.BytesIO(data))
        return cls(z["vectors"], z["dims"], z["amounts"], z["begins"], z["rows"].astype(np.intp), z["stops"], z["missing"])

    def possible(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact score) of all rows that may be among the k best; own is a query's own row here or -1."""
        n, norms = len(self.vectors), np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        top = norms.max(initial=0) * (np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1)) + self.missing[-1]).max(initial=0)
        # integers below 2**24 add up exactly in single precision; of larger ones the rounding is part of the bound
        kind = np.float32 if top * np.sqrt(max(1, queries.shape[1])) < 1 << 24 else np.float64
        slack = 0.0 if kind is np.float32 else 1e-12 * top * max(1, queries.shape[1])
        weights = np.ascontiguousarray(queries.T.astype(kind))
        scores, done = np.zeros((n, len(queries)), kind), 0
        hidden = np.flatnonzero(own >= 0)
        for at, missing in zip(self.stops, self.missing, strict=True):
            for s in range(done, at):
                scores[self.rows[self.begins[s] : self.begins[s + 1]]] += kind(self.amounts[s]) * weights[self.dims[s]]
            done = at
            now = scores.T.astype(np.float64)
            now[hidden, own[hidden]] = -np.inf
            least = np.full(len(queries), -np.inf)
            if n > k:
                best = np.argpartition(now, n - k, axis=1)[:, n - k :]
                exact = np.einsum("qkd,qd->qk", self.vectors[best], queries).astype(np.float64)
                least = np.where(np.isneginf(np.take_along_axis(now, best, 1)), -np.inf, exact).min(1)
            may = now + norms[:, None] * missing[None, :] + slack >= (least - 1e-15 * np.abs(np.where(np.isinf(least), 0, least)))[:, None]
            may[hidden, own[hidden]] = False
            if at == self.stops[-1] or may.mean() <= FEW:
                break
        asked, row = np.nonzero(may)
        exact = np.concatenate([np.einsum("ij,ij->i", self.vectors[row[i : i + 65536]], queries[asked[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0, np.int64)])
        return asked, row, exact


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _build(block: pa.Table) -> pa.Table:
    """A row for each length of a shard's vectors."""
    out = []
    for dim in pc.unique(block.column("dim")).to_pylist():
        part = block.filter(pc.equal(block.column("dim"), dim)).sort_by("uid")
        ids = part.column("vec_id")
        out.append((part.column("shard")[0].as_py(), dim, Index.build(_matrix(part.column("v")).reshape(len(part), dim)).dump(), part.column("uid").to_numpy().tobytes(), ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy().tobytes()))
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "dim", "index", "uids", "ids", "nulls"])


def _ask(block: pa.Table, k: int) -> pa.Table:
    """The k best rows of one shard for each query of one block."""
    is_index = block.column("index").is_valid()
    found: list[list[np.ndarray]] = []
    nulls: list[np.ndarray] = []
    for held in block.filter(is_index).select(["dim", "index", "uids", "ids", "nulls"]).to_pylist():
        asks = block.filter(pc.and_(pc.invert(is_index), pc.equal(block.column("dim"), held["dim"])))
        if not asks.num_rows:
            continue
        index, uids, ids = Index.load(held["index"]), np.frombuffer(held["uids"], np.int64), np.frombuffer(held["ids"], np.int64)
        unnamed = np.frombuffer(held["nulls"], bool)
        for i in range(0, asks.num_rows, BATCH):
            part = asks.slice(i, BATCH)
            uid = part.column("uid").to_numpy()
            place = np.minimum(np.searchsorted(uids, uid), len(uids) - 1)
            asked, row, score = index.possible(_matrix(part.column("v")).reshape(len(part), held["dim"]), np.where(uids[place] == uid, place, -1), k)
            order = np.lexsort((uids[row], ids[row], unnamed[row], -score, asked))
            asked, row, score = asked[order], row[order], score[order]
            first = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
            found.append([uid[asked[first]], uids[row[first]], ids[row[first]], score[first]])
            nulls.append(unnamed[row[first]])
    ask, uid, vec_id, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    return pa.table([pa.array(ask), pa.array(uid), pa.array(vec_id, mask=np.concatenate(nulls) if nulls else None), pa.array(score)], ["ask", "uid", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, divisor: int = DIVISOR, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query; vectors has vec_id and embedding."""
    spark = ship(vectors.sparkSession)
    scratch = scratch or Scratch(spark, "topk")
    rows = numbered(scaled(vectors), scratch).withColumn("dim", F.size("v"))
    asking = F.coalesce(F.col("vec_id") % divisor == 0, F.lit(False))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(asking).alias("q")).first()
    shards, blocks = max(1, -(-sizes["n"] // SHARD)), max(1, -(-sizes["q"] // BLOCK))
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    indexes = scratch.keep(dealt.groupBy("shard").applyInArrow(_build, "shard long, dim int, index binary, uids binary, ids binary, nulls binary"), "indexes")
    queries = scratch.keep(rows.where(asking), "queries")
    asks = queries.select("uid", "dim", "v", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).alias("block"), many(shards).alias("shard"))
    both = asks.unionByName(indexes.withColumn("block", many(blocks)), allowMissingColumns=True)
    found = scratch.keep(both.groupBy("shard", "block").applyInArrow(lambda t: _ask(t, k), FOUND), "found")
    best = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid"))
    ranked = found.withColumn("rank", best).where(F.col("rank") <= k)
    return ranked.join(queries.select(F.col("uid").alias("ask"), F.col("vec_id").alias("query_id")), "ask").select("query_id", "rank", "vec_id", "score")


def op11_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) WHERE rank <= 5
"""
