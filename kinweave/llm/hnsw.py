"""Embedding near-dedup with a hierarchical navigable small-world graph for each shard.

Vectors of one label are dealt into shards of about SHARD rows by a hash, after equal vectors are collapsed into classes (pre-aggregated;
the smallest id stands for its class, whose size counts). Each shard builds a graph in one task; blocks of BLOCK queries then search
every shard of their label. A query whose beam is full of links is searched again with a beam twice as wide; an audit compares
AUDIT queries of each block and shard with brute force and widens the whole block's beam until it finds RECALL of their links. Cosines are
verified in double precision, and the links of a task are reduced to a spanning forest before components are joined over all shards.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
nothing, as do vectors of different lengths. Rows that repeat an id count as further vectors. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, table
from .components import components

THRESHOLD = 0.98
SHARD = 8192
BLOCK = 2048
LINKS, BEAM, BUILD_BEAM = 16, 48, 48
AUDIT, RECALL = 64, 0.999
BATCH = 256
#: Cosines in single precision are this close to those in double.
SLACK = 1e-4


class Graph:
    """HNSW over unit vectors: layer 0 has 2 * LINKS neighbours a node, the others LINKS."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], nodes: list[np.ndarray], entry: int):
        self.unit, self.layers, self.nodes, self.entry = unit, layers, nodes, entry

    @classmethod
    def build(cls, unit: np.ndarray) -> Graph:
        n = len(unit)
        rng = np.random.default_rng(n)
        order = rng.permutation(n)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 4)
        level[order[0]] = max(level.max(), 0)
        top = int(level.max())
        self = cls(unit, [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)], [np.flatnonzero(level >= k) for k in range(top + 1)], int(order[0]))
        done, size = 1, 1
        while done < n:
            batch = order[done : done + size]
            entries = np.full((len(batch), 1), self.entry)
            inner = unit[batch] @ unit[batch].T
            np.fill_diagonal(inner, -2)
            for k in range(top, -1, -1):
                found, sims = self._beam(unit[batch], entries, k, BUILD_BEAM)
                entries = found[:, :8]
                here = level[batch] >= k
                if here.any():
                    peers = np.where(here[None, :], inner, -2)[here]
                    near = np.argsort(-peers, axis=1)[:, :LINKS]
                    peer_sims = np.take_along_axis(peers, near, 1)
                    self._connect(batch[here], np.concatenate([found[here], np.where(peer_sims > -2, batch[near], -1)], 1), np.concatenate([sims[here], peer_sims], 1), k)
            done += len(batch)
            size = min(BATCH, done)
        return self

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that aren't nearer to one already chosen, nearest first, then the nearest of the rest."""
        order = np.argsort(-np.where(ids >= 0, sims, -3), axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        vectors = self.unit[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", vectors, vectors)
        valid = ids >= 0
        for j in range(1, ids.shape[1]):  # an id is taken once
            valid[:, j] &= ~(ids[:, :j] == ids[:, j : j + 1]).any(1)
        chosen = np.zeros(ids.shape, bool)
        nearest = np.full(ids.shape, -2.0)
        for j in range(ids.shape[1]):
            take = valid[:, j] & (nearest[:, j] < sims[:, j]) & (chosen.sum(1) < most)
            chosen[:, j] = take
            nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
        rank = np.argsort(~chosen + 2 * ~valid, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out

    def _connect(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        layer = self.layers[k]
        layer[new, :LINKS] = self._chosen(np.where(ids == new[:, None], -1, ids), sims, LINKS)
        backs: dict[int, list[int]] = {}
        for node, row in zip(new, layer[new, :LINKS], strict=True):
            for other in row[row >= 0]:
                backs.setdefault(int(other), []).append(int(node))
        full = []
        for other, nodes in backs.items():
            row = layer[other]
            free = np.flatnonzero(row < 0)
            nodes = [x for x in nodes if x not in row]
            row[free[: len(nodes)]] = nodes[: len(free)]
            if len(nodes) > len(free):
                full.append((other, np.concatenate([row, nodes[len(free) :]])))
        for i in range(0, len(full), BATCH):
            some = full[i : i + BATCH]
            width = max(len(r) for _, r in some)
            at = np.array([o for o, _ in some])
            ids = np.array([np.pad(r, (0, width - len(r)), constant_values=-1) for _, r in some])
            layer[at] = self._chosen(ids, np.einsum("bid,bd->bi", self.unit[np.maximum(ids, 0)], self.unit[at]), layer.shape[1])

    def _beam(self, queries: np.ndarray, entries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the beam of each query, best first; -1 where there are fewer."""
        count, layer = len(queries), self.layers[k]
        row = np.arange(count)[:, None]
        seen = np.zeros((count, len(self.unit) + 1), bool)
        ids = np.full((count, beam), -1)
        sims = np.full((count, beam), -3.0)
        opened = np.ones((count, beam), bool)
        fresh = entries
        while True:
            fresh = np.where(fresh >= 0, fresh, len(self.unit))
            fresh = np.sort(fresh, axis=1)
            again = np.concatenate([np.zeros((count, 1), bool), fresh[:, 1:] == fresh[:, :-1]], 1)
            usable = ~seen[row, fresh] & (fresh < len(self.unit)) & ~again
            seen[row, fresh] = True
            near = np.where(usable, np.einsum("bmd,bd->bm", self.unit[np.minimum(fresh, len(self.unit) - 1)], queries), -3.0)
            ids = np.concatenate([ids, np.where(usable, fresh, -1)], 1)
            sims = np.concatenate([sims, near], 1)
            opened = np.concatenate([opened, ~usable], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, opened = (np.take_along_axis(x, best, 1) for x in (ids, sims, opened))
            closed = np.argsort(opened, axis=1, kind="stable")[:, :4]
            go = ~np.take_along_axis(opened, closed, 1)
            if not go.any():
                return ids, sims
            np.put_along_axis(opened, closed, True, 1)
            nodes = np.where(go, np.take_along_axis(ids, closed, 1), -1)
            fresh = np.where(nodes[:, :, None] >= 0, layer[np.maximum(nodes, 0)], -1).reshape(count, -1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = [], []
        for i in range(0, len(queries), BATCH):
            q = queries[i : i + BATCH]
            entries = np.full((len(q), 1), self.entry)
            for k in range(len(self.layers) - 1, 0, -1):
                entries = self._beam(q, entries, k, 16)[0][:, :8]
            found = self._beam(q, entries, 0, beam)
            ids.append(found[0])
            sims.append(found[1])
        return np.concatenate(ids), np.concatenate(sims)

    def dump(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, unit=self.unit, entry=self.entry, **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        import io

        z = np.load(io.BytesIO(data))
        layers = [z[f"layer{k}"] for k in range(sum(x.startswith("layer") for x in z.files))]
        return cls(z["unit"], layers, [], int(z["entry"]))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def links_in(graph: Graph, own: np.ndarray, queries: np.ndarray, threshold: float, same: np.ndarray) -> list[np.ndarray]:
    """Nodes linked with each query (own: the nodes in double precision; same: the query's own node or -1)."""
    low = queries.astype(np.float32)
    pending, beam = np.arange(len(queries)), min(BEAM, len(own))
    found: list = [None] * len(queries)
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    truth = queries[sample] @ own.T >= threshold
    while len(pending):
        ids, sims = graph.search(low[pending], beam)
        wide = (sims[:, -1] >= threshold - SLACK) & (beam < len(own))
        for i, q in enumerate(pending):
            near = ids[i][(ids[i] >= 0) & (sims[i] >= threshold - SLACK)]
            near = near[(own[near] @ queries[q]) >= threshold]
            found[q] = near
        if beam >= len(own):
            break
        beam = min(2 * beam, len(own))
        hit = sum(len(found[q]) for q in sample)
        if hit < RECALL * truth.sum() and not wide[np.isin(pending, sample)].any():
            pending = np.arange(len(queries))
        else:
            pending = pending[wide]
    return [x[x != s] for x, s in zip(found, same, strict=True)]


def _build(block: pa.Table) -> pa.Table:
    block = block.sort_by("vec_id")
    unit = _unit(_matrix(block.column("embedding")))
    graph = Graph.build(unit.astype(np.float32))
    return pa.table({
        "part": [block.column("part")[0].as_py()], "shard": [block.column("shard")[0].as_py()], "graph": pa.array([graph.dump()], pa.binary()),
        "own": pa.array([unit.tobytes()], pa.binary()), "ids": pa.array([block.column("vec_id").to_numpy().tobytes()], pa.binary()), "sizes": pa.array([block.column("size").to_numpy().tobytes()], pa.binary()),
    })


def _ask(block: pa.Table, threshold: float) -> pa.Table:
    """One shard's graph and one block of queries: links of each query, and a spanning forest of (vec_id, other)."""
    is_index = block.column("graph").is_valid()
    index, asks = block.filter(is_index), block.filter(pc.invert(is_index))
    names = ["vec_id", "links", "other"]
    if not index.num_rows or not asks.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names)
    ids, sizes = (np.frombuffer(index.column(c)[0].as_py(), np.int64) for c in ("ids", "sizes"))
    own = np.frombuffer(index.column("own")[0].as_py(), np.float64).reshape(len(ids), -1)
    asked = asks.column("vec_id").to_numpy()
    place = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
    found = links_in(Graph.load(index.column("graph")[0].as_py()), own, _unit(_matrix(asks.column("embedding"))), threshold, np.where(ids[place] == asked, place, -1))
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up] = root.setdefault(root[up], root[up])
        return x

    out: list[list] = [[], [], []]
    for q, near in zip(asked.tolist(), found, strict=True):
        if len(near):
            out[0].append(q)
            out[1].append(int(sizes[near].sum()))
            out[2].append(None)
            for other in ids[near].tolist():
                a, b = top(q), top(other)
                root[max(a, b)] = min(a, b)
    for x in list(root):
        if top(x) != x:
            out[0].append(x)
            out[1].append(None)
            out[2].append(top(x))
    return pa.table([pa.array(x, pa.int64()) for x in out], names)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; vectors has vec_id, embedding and label."""
    spark = ship(vectors.sparkSession)
    scratch = scratch or Scratch(spark, "hnsw")
    raw = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", raw.alias("embedding"), F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False)).alias("sound"))
    # vectors of one label and length are compared; -0.0 and 0.0 are one value
    same = F.transform("embedding", lambda x: x + F.lit(0.0))
    rows = scratch.keep(rows.withColumns({"embedding": same, "part": F.concat_ws("|", F.size("embedding"), F.col("label").cast("string"))}).withColumns({"k1": F.xxhash64("embedding"), "k2": F.hash("embedding")}), "rows")
    usable, keys = rows.where("sound"), ["part", "k1", "k2"]
    classes = scratch.keep(usable.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    # dropDuplicates by id and key only meets rows that are alike
    reps = usable.join(classes, keys).where("vec_id = rep").dropDuplicates(["vec_id", *keys]).select("part", "vec_id", "size", "embedding")
    counts = reps.groupBy("part").agg(F.count("*").alias("n"))
    sized = reps.join(counts, "part").withColumns({"shards": F.ceil(F.col("n") / SHARD), "blocks": F.ceil(F.col("n") / BLOCK)})
    sized = sized.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), "shards"), "block": F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks")})
    sized = scratch.keep(sized, "sized")
    graphs = scratch.keep(sized.select("part", "shard", "vec_id", "size", "embedding").groupBy("part", "shard").applyInArrow(_build, "part string, shard long, graph binary, own binary, ids binary, sizes binary"), "graphs")
    many = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    asks = sized.select("part", many("shards").alias("shard"), "block", "vec_id", "embedding")
    indexes = graphs.join(counts.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "part").select("part", "shard", many("blocks").alias("block"), "graph", "own", "ids", "sizes")
    both = asks.unionByName(indexes, allowMissingColumns=True)
    answers = scratch.keep(both.groupBy("part", "shard", "block").applyInArrow(lambda t: _ask(t, threshold), "vec_id long, links long, other long"), "answers")
    member = usable.join(classes.where("size > 1"), keys).where("vec_id <> rep").select(F.col("rep").alias("u"), F.col("vec_id").alias("v"))
    part = components(answers.where("other is not null").select(F.col("vec_id").alias("u"), F.col("other").alias("v")).unionByName(member), scratch)
    links = answers.where("links is not null").groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "rep", "left").select(*keys, (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = usable.select("vec_id", *keys).join(per_class, keys).join(part.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    out = out.unionByName(rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_hnsw(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, m.vec_id = c.m AS kept
FROM embeddings m JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) c ON c.a = m.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) n ON n.a = m.vec_id
"""
