"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard, with queries sent where they can gain."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirekit.llm.common import column, rebatched, saved

#: Edges of a node, width of the beam while building and while searching, and how much closer a kept edge must be to make another needless.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 64, 64, 1.2
#: A shard has about SHARD_ROOT times the root of the number of vectors, SHARD_MOST at most; one task puts about TASK_QUERIES queries to it.
SHARD_ROOT, SHARD_MOST, TASK_QUERIES = 40, 250_000, 100_000
#: Centres of cells are fitted to so many vectors at most, those of the smallest hash of vec_id, in so many rounds.
SAMPLE, ROUNDS = 20_000, 10
#: Vectors with a vec_id divisible by this are the queries.
EVERY = 20


class Graph:
    """A directed graph over distinct vectors: edges[i] are the neighbours of i, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, start: int | None = None) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.norm = np.einsum("nd,nd->n", self.x, self.x)
        centre = self.x.mean(axis=0)
        self.start = int(np.argmin(self.norm - 2 * self.x @ centre)) if start is None else start
        self.edges = np.full((len(self.x), DEGREE), -1, np.int32) if edges is None else edges

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the `beam` nearest that a greedy beam search finds for each query, nearest first; -1 and inf where there are fewer.

        All queries take a step at a time: each looks at the neighbours of its nearest node that it hasn't looked at yet."""
        m = len(q)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        seen = np.zeros((m, len(self.x)), bool)
        q2 = np.einsum("nd,nd->n", q, q)
        ids[:, 0], done[:, 0] = self.start, False
        dist[:, 0] = self.norm[self.start] - 2 * q @ self.x[self.start] + q2
        seen[:, self.start] = True
        live = np.arange(m)
        while len(live):
            left = ~done[live]
            live = live[left.any(axis=1)]
            if not len(live):
                break
            at = np.argmax(~done[live], axis=1)
            done[live, at] = True
            nbr = self.edges[ids[live, at]]
            fresh = (nbr >= 0) & ~seen[live[:, None], nbr]
            nbr = np.where(fresh, nbr, 0)
            rows, cols = np.nonzero(fresh)
            seen[live[rows], nbr[rows, cols]] = True
            d = self.norm[nbr] - 2 * np.matmul(self.x[nbr], q[live][:, :, None])[:, :, 0] + q2[live][:, None]
            d = np.where(fresh, d, np.inf).astype(np.float32)
            all_d = np.concatenate([dist[live], d], axis=1)
            all_i = np.concatenate([ids[live], np.where(fresh, nbr, -1)], axis=1)
            all_e = np.concatenate([done[live], ~fresh], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live], ids[live], done[live] = (np.take_along_axis(v, order, 1) for v in (all_d, all_i, all_e))
        return ids, dist

    def pruned(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """DEGREE of each point's candidates (-1: none), robustly pruned: from the nearest on, one is kept unless ALPHA times its distance to one kept is within its distance to the point."""
        cand = np.where(cand == points[:, None], -1, cand)
        x = self.x[cand]
        d = self.norm[cand] - 2 * np.matmul(x, self.x[points][:, :, None])[:, :, 0] + self.norm[points][:, None]
        d = np.where(cand >= 0, d, np.inf)
        order = np.lexsort((cand, d), axis=1)
        cand, d, x = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(x, order[:, :, None], 1)
        n2 = self.norm[cand]
        between = n2[:, :, None] + n2[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        alive = np.isfinite(d)
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        out = np.full((len(points), DEGREE), -1, np.int32)
        row = np.arange(len(points))
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            at = np.argmax(alive, axis=1)
            out[some, k] = cand[row[some], at[some]]
            alive[row, at] = False
            alive &= ~(some[:, None] & (ALPHA**2 * between[row, at] <= d))
        return out

    def insert(self, points: np.ndarray) -> None:
        """Adds points: a greedy search proposes neighbours, robust pruning keeps diverse ones, and the edges back are added, pruned where they are too many."""
        found, _ = self.search(self.x[points], BUILD_BEAM)
        self.edges[points] = self.pruned(points, np.concatenate([found, self.edges[points]], axis=1))
        src, k = np.nonzero(self.edges[points] >= 0)
        to, back = self.edges[points][src, k], points[src]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max()) if len(count) else 0), -1, np.int32)
        wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = back
        have = (self.edges[nodes] >= 0).sum(axis=1)
        roomy = have + count <= DEGREE
        for i in np.flatnonzero(roomy):
            new = np.setdiff1d(wide[i, : count[i]], self.edges[nodes[i], : have[i]])
            self.edges[nodes[i], have[i] : have[i] + len(new)] = new
        full = np.flatnonzero(~roomy)
        for a in range(0, len(full), 256):
            part = full[a : a + 256]
            some = int(count[part].max())
            self.edges[nodes[part]] = self.pruned(nodes[part], np.concatenate([self.edges[nodes[part]], wide[part, :some]], axis=1))

    @classmethod
    def built(cls, vectors: np.ndarray, seed: int = 5) -> Graph:
        g = cls(vectors)
        rest = np.random.default_rng(seed).permutation(len(vectors))
        rest = rest[rest != g.start].astype(np.int64)
        at = 0
        while at < len(rest):
            size = min(256, max(1, at))
            g.insert(rest[at : at + size])
            at += size
        return g


def centres_of(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n centres of the sample, by Lloyd's rounds from n of its vectors; fewer where the sample has fewer distinct vectors."""
    distinct = np.unique(sample, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]].astype(np.float64)
    for _ in range(ROUNDS):
        near = np.argmin((c**2).sum(axis=1) - 2 * sample @ c.T, axis=1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def reachable(q: np.ndarray, far: np.ndarray, own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Whether each query's ball of radius `far` reaches over the border between its own cell and each other one.

    The points nearer to centre j than to centre i are at least (d(q,j)^2 - d(q,i)^2) / 2d(i,j) away from q, so a cell out of reach holds none of its neighbours."""
    d2 = (centres**2).sum(axis=1) - 2 * q @ centres.T  # less |q|^2, which falls out
    between = np.sqrt(np.maximum(((centres[own][:, None] - centres[None]) ** 2).sum(axis=2), 0)) if len(q) else np.zeros((0, len(centres)))
    gap = d2 - d2[np.arange(len(q)), own][:, None]
    out = gap <= 2 * between * (np.minimum(far, 1e30)[:, None] * (1 + 1e-5) + 1e-6)
    out[np.arange(len(q)), own] = False
    return out


def _vectors(cells: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float32).reshape(-1, dim)


def _searched(index: DataFrame, asked: DataFrame, shards: int, k: int, beam: int, task_queries: int) -> DataFrame:
    """(vec_id, neighbour, distance): the k nearest in each shard that each vector of asked (shard, vec_id, vec; saved) is put to.

    A task holds one shard's graph and a batch of queries: graphs are dealt to as many salts as their queries need."""
    busiest = asked.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, math.ceil(busiest / task_queries))
    graphs = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("vec_id"), F.col("vectors").alias("vec"), "dim", "start", "edges", "ids", "copies")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("dim", "int"), ("start", "int"), ("edges", "binary"), ("ids", "binary"), ("copies", "binary"))]
    queries = asked.select("shard", F.pmod(F.xxhash64(F.col("vec_id") + 1), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "vec_id", "vec", *none)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = ids = first = None

        def answers(who: np.ndarray, cells: list[bytes]) -> pa.RecordBatch:
            q = _vectors(cells, g.x.shape[1])
            found, _ = g.search(q, beam)
            out = [[], [], []]
            for me, at, near in zip(who.tolist(), q.astype(np.float64), found):
                near = near[near >= 0]
                far = np.sqrt(((g.x[near].astype(np.float64) - at) ** 2).sum(axis=1))
                order = np.lexsort((near, far))
                got: list[tuple[float, int]] = []
                for node, d in zip(near[order].tolist(), far[order].tolist()):
                    if len(got) >= k and d > got[k - 1][0]:
                        break
                    got += [(d, i) for i in ids[first[node] : min(first[node + 1], first[node] + k + 1)].tolist() if i != me]
                for d, i in sorted(got)[:k]:
                    out[0].append(me)
                    out[1].append(i)
                    out[2].append(d)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["vec_id", "neighbour", "distance"])

        for batch in it:
            kind, who = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("kind", "vec_id"))
            marks = [*np.flatnonzero(kind == 0).tolist(), batch.num_rows]
            for lo, hi in zip([-1, *marks], marks):
                if lo >= 0:
                    row = {c: column(batch, c)[lo].as_py() for c in ("vec", "dim", "start", "edges", "ids", "copies")}
                    g = Graph(_vectors([row["vec"]], row["dim"]), np.frombuffer(row["edges"], np.int32).reshape(-1, DEGREE), row["start"])
                    ids = np.frombuffer(row["ids"], np.int64)
                    first = np.concatenate([[0], np.cumsum(np.frombuffer(row["copies"], np.int32))])
                cells = column(batch, "vec").slice(lo + 1, hi - lo - 1).to_pylist()
                for a in range(0, len(cells), 512):
                    yield answers(who[lo + 1 + a : min(lo + 1 + a + 512, hi)], cells[a : a + 512])

    both = graphs.union(queries).repartition(max(shards * salts, 1), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(run, "vec_id bigint, neighbour bigint, distance double")


def nearest(vectors: DataFrame, k: int = 10, every: int = EVERY, shard_rows: int | None = None, task_queries: int = TASK_QUERIES, beam: int = BEAM) -> DataFrame:
    """The k nearest others, in all rows, of each vector whose vec_id is divisible by `every`, by Euclidean distance: (vec_id, rank, neighbour, distance).

    rank counts from 1. Centres are fitted to a bounded sample (SAMPLE), and every vector belongs to the cell of its nearest centre; a cell
    of more than 2 shard_rows vectors is split by a hash of vec_id. So shards are about shard_rows large, whatever the data (by default SHARD_ROOT times the root of
    their number). In each shard greedy searches propose neighbours, and pruning with a relaxed distance (ALPHA) keeps edges in
    diverse directions. A query first visits the shards of its own cell, by beam search, and then those of each cell that its k-th distance reaches into.
    That bound is exact, so only the beam search is approximate: in clustered vectors a query visits few cells, in
    vectors without structure all that could hold a neighbour. Equal vectors are one node of a graph, so all of them are found.

    Rows with a null vec_id or embedding, or one with a null, NaN or infinite value, are left out. Vectors of different lengths are no neighbours: each length has cells of
    its own. Rows of one vec_id are one vector, the largest. Ties go to the smaller vec_id. Where there are fewer than k others, there are fewer rows. An empty table gives none.
    """
    schema = "vec_id bigint, rank int, neighbour bigint, distance double"
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    x = x.where(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    x = saved(x.groupBy("vec_id").agg(F.max("embedding").alias("embedding")))
    lengths = {r.dim: r.n for r in x.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    n = sum(lengths.values())
    share = min(1.0, 1.1 * SAMPLE / n)  # a cut by the hash first, so that no task sends more than its share
    few = x.where(F.xxhash64("vec_id") <= F.lit(int(share * (1 << 64)) - (1 << 63) - 1).cast("bigint")) if share < 1 else x
    sample = [np.array(r.embedding, np.float64) for r in few.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    rows = shard_rows or min(SHARD_MOST, max(1, math.ceil(SHARD_ROOT * math.sqrt(n))))
    centres: dict[int, np.ndarray] = {}
    base: dict[int, int] = {}
    total = 0
    for dim in sorted(lengths):
        own = [v for v in sample if len(v) == dim] or [np.zeros(dim)]
        centres[dim], base[dim] = centres_of(np.stack(own), math.ceil(lengths[dim] / rows)), total
        total += len(centres[dim])

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 4096):
            lists = column(batch, "embedding").to_pylist()
            cell, vec = [], []
            for dim in {len(v) for v in lists}:
                at = [i for i, v in enumerate(lists) if len(v) == dim]
                m = np.array([lists[i] for i in at], np.float32) + np.float32(0)  # no negative zeros
                c = centres[dim]
                near = np.argmin((c**2).sum(axis=1) - 2 * m.astype(np.float64) @ c.T, axis=1) + base[dim]
                cell += zip(at, near.tolist())
                vec += zip(at, (r.tobytes() for r in m))
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array([c for _, c in sorted(cell)], pa.int32()), pa.array([v for _, v in sorted(vec)], pa.binary())], ["vec_id", "cell", "vec"])

    x = saved(x.mapInArrow(placed, "vec_id bigint, cell int, vec binary"))
    parts = [0] * total
    for r in x.groupBy("cell").count().collect():
        parts[r["cell"]] = math.ceil(r["count"] / (2 * rows))
    begin = np.concatenate([[0], np.cumsum(parts)]).tolist()
    spark = vectors.sparkSession
    cells = F.broadcast(spark.createDataFrame([(c, begin[c], parts[c]) for c in range(total) if parts[c]], "cell int, begin int, parts int"))  # a row for each cell: n / shard_rows of them
    dims = [dim for dim in sorted(lengths) for _ in range(len(centres[dim]))]

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, dim = pdf.vec_id.to_numpy(np.int64), dims[int(pdf.cell.iloc[0])]
        order = np.argsort(ids)
        ids, all_x = ids[order], _vectors(pdf.vec.tolist(), dim)[order]
        distinct, owner = np.unique(all_x, axis=0, return_inverse=True)
        g = Graph.built(distinct)
        by = np.argsort(owner.ravel(), kind="stable")
        return pd.DataFrame({"shard": [key[0]], "dim": [dim], "start": [g.start], "vectors": [distinct.tobytes()], "edges": [g.edges.tobytes()], "ids": [ids[by].tobytes()], "copies": [np.bincount(owner.ravel()).astype(np.int32).tobytes()]})

    shard = (F.col("begin") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard")
    index = saved(x.join(cells, "cell").select("vec_id", "cell", "vec", shard).repartition(begin[-1], "shard").groupBy("shard").applyInPandas(build, "shard int, dim int, start int, vectors binary, edges binary, ids binary, copies binary"))
    visits = F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("parts") - 1)).alias("shard")
    asks = saved(x.where(F.expr(f"pmod(vec_id, {every}) = 0")))
    own = saved(_searched(index, saved(asks.join(cells, "cell").select(visits, "vec_id", "vec")), begin[-1], k, beam, task_queries))
    best = W.partitionBy("vec_id").orderBy("distance", "neighbour")
    far = own.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("vec_id", F.col("distance").alias("far"))

    def more(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 1024):
            if not batch.num_rows:
                continue
            cell, who = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("cell", "vec_id"))
            radius = np.array([math.inf if v is None else v for v in column(batch, "far").to_pylist()])
            vec = column(batch, "vec").to_pylist()
            for dim in sorted({dims[c] for c in cell}):
                at = np.flatnonzero([dims[c] == dim for c in cell])
                reach = reachable(_vectors([vec[i] for i in at], dim).astype(np.float64), radius[at], cell[at] - base[dim], centres[dim])
                row, to = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([pa.array((to + base[dim]).astype(np.int32)), pa.array(who[at][row]), pa.array([vec[i] for i in at[row]], pa.binary())], ["cell", "vec_id", "vec"])

    away = saved(asks.join(far, "vec_id", "left").mapInArrow(more, "cell int, vec_id bigint, vec binary").join(cells, "cell").select(visits, "vec_id", "vec"))
    near = own.union(_searched(index, away, begin[-1], k, beam, task_queries))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("vec_id", F.col("rank").cast("int").alias("rank"), "neighbour", "distance")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("distance", F.round("distance", 6))


#: The exact neighbours, which the graphs find all of at the size of the correctness check; recall at larger sizes is tested.
ORACLE_SQL = """WITH d AS (SELECT q.vec_id, v.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS distance
 FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour)::INT AS rank, neighbour, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) <= 10"""
