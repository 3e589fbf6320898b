"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard, searched by beams.

Distinct vectors are dealt to shards of some SHARD vectors by hash. A shard's graph grows in batches: beam searches from
the medoid propose neighbours for a batch's points, and robust pruning keeps at most DEGREE of them: nearest first, each
one rules out those that are SLACK times closer to it than to the point, so that edges stay diverse. Kept edges are added
in reverse too, and nodes with too many are pruned anew; in the end every node is made reachable. Queries search every shard with a beam of QUERY_BEAM vectors, in blocks; their
best are measured again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, materialize, tidy

SHARD, DEGREE, BEAM, QUERY_BEAM, WIDE, SLACK, BATCH = 4096, 32, 64, 96, 4, 1.2, 512

#: Queries of a block, and blocks that one task searches in a shard.
BLOCK, TOGETHER = 512, 16


def squared(points: np.ndarray, places: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of points[places] (rows x k) from centre (rows x dimensions)."""
    diff = points[places] - centre[:, None, :]
    return np.einsum("rkd,rkd->rk", diff, diff)


class Graph:
    """points (n x dimensions), edges (n x DEGREE, -1 where there is none; one column more once built), and the entry point."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, entry: int = 0) -> None:
        self.points, self.entry = points, entry
        self.edges = np.full((len(points), DEGREE), -1, np.int32) if edges is None else edges

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances) of the beam nearest points found for each query, nearest first; -1 and inf fill up.

        Each step opens the WIDE nearest unopened points of every query's beam.
        """
        rows = np.arange(len(queries))[:, None]
        places = np.full((len(queries), beam), -1, np.int64)
        far = np.full((len(queries), beam), np.inf, np.float32)
        opened = np.ones((len(queries), beam), bool)
        seen = np.zeros((len(queries), len(self.points) + 1), bool)
        seen[:, -1] = True
        places[:, 0], far[:, :1], opened[:, 0] = self.entry, squared(self.points, np.full((len(queries), 1), self.entry), queries), False
        seen[:, self.entry] = True
        live = np.arange(len(queries))
        while len(live):
            score = np.where(opened[live], np.inf, far[live])
            pick = np.argpartition(score, WIDE - 1, axis=1)[:, :WIDE]
            real = np.isfinite(np.take_along_axis(score, pick, 1))
            on = real.any(1)
            live, pick, real = live[on], pick[on], real[on]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            nodes = np.where(real, places[live[:, None], pick], 0)
            near = np.where(real[:, :, None], self.edges[nodes], -1).reshape(len(live), -1).astype(np.int64)
            fresh = ~seen[live[:, None], near]
            order = np.argsort(near, axis=1, kind="stable")
            sorted_near = np.take_along_axis(near, order, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, order, np.concatenate([np.zeros((len(live), 1), bool), sorted_near[:, 1:] == sorted_near[:, :-1]], 1), 1)
            fresh &= ~again & (near >= 0)
            seen[live[:, None], np.where(fresh, near, len(self.points))] = True
            distance = np.where(fresh, squared(self.points, np.where(fresh, near, 0), queries[live]), np.inf).astype(np.float32)
            every_far = np.concatenate([far[live], distance], 1)
            keep = np.argpartition(every_far, beam - 1, axis=1)[:, :beam]
            places[live] = np.take_along_axis(np.concatenate([places[live], near], 1), keep, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], ~fresh], 1), keep, 1)
            far[live] = np.take_along_axis(every_far, keep, 1)
        order = np.argsort(far, axis=1, kind="stable")
        far = far[rows, order]
        return np.where(np.isfinite(far), places[rows, order], -1), far

    def prune(self, own: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Robust pruning: at most DEGREE of the candidate places (rows x k, -1: none) for each point of own."""
        good = (places >= 0) & (places != own[:, None])
        distance = np.where(good, squared(self.points, np.where(good, places, 0), self.points[own]), np.inf)
        order = np.argsort(distance, axis=1, kind="stable")
        places, distance = np.take_along_axis(places, order, 1), np.take_along_axis(distance, order, 1)
        alive = np.isfinite(distance)
        alive[:, 1:] &= places[:, 1:] != places[:, :-1]
        vectors = self.points[np.where(alive, places, 0)]
        out, rows = np.full((len(own), DEGREE), -1, np.int32), np.arange(len(own))
        for k in range(DEGREE):
            first = alive.argmax(1)
            on = alive[rows, first]
            if not on.any():
                break
            out[on, k] = places[rows, first][on]
            diff = vectors - vectors[rows, first][:, None, :]
            alive &= SLACK * SLACK * np.einsum("rkd,rkd->rk", diff, diff) > distance
            alive[rows, first] = False
        return out

    def link(self, own: np.ndarray, edges: np.ndarray) -> None:
        """Set the edges of points, and add the reverse edges."""
        self.edges[own] = edges
        source, target = np.repeat(own, DEGREE), edges.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        used = (self.edges[nodes] >= 0).sum(1)
        fits = used + counts <= DEGREE
        rank = np.arange(len(target)) - np.repeat(starts, counts)
        inside = np.repeat(fits, counts)
        self.edges[target[inside], (np.repeat(used, counts) + rank)[inside]] = source[inside]
        over = np.flatnonzero(~fits)
        for part in np.array_split(over[np.argsort(counts[over])], max(1, len(over) // 128)):
            if len(part):
                new = np.full((len(part), int(counts[part].max())), -1, np.int64)
                for k, n in enumerate(part):
                    new[k, : counts[n]] = source[starts[n] : starts[n] + counts[n]]
                self.edges[nodes[part]] = self.prune(nodes[part], np.concatenate([self.edges[nodes[part]].astype(np.int64), new], 1))

    @staticmethod
    def build(points: np.ndarray) -> Graph:
        """Insert all points, in batches that grow with the graph; then all once more against the whole graph."""
        graph = Graph(points, entry=int(((points - points.mean(0)) ** 2).sum(1).argmin()) if len(points) else 0)
        order = np.random.default_rng(1).permutation(len(points))
        order = np.concatenate([[graph.entry], order[order != graph.entry]]).astype(np.int64)[: len(points)]
        for again in (False, True):
            at = 0 if again else 1
            while at < len(order):
                own = order[at : at + (BATCH if again else min(BATCH, max(8, at // 2)))]
                found, _ = graph.search(points[own])
                found = np.concatenate([found, graph.edges[own].astype(np.int64)], 1) if again else found
                graph.link(own, graph.prune(own, found))
                at += len(own)
        graph.reach_all()
        return graph

    def reached(self, start: int, seen: np.ndarray) -> None:
        """Mark in seen all nodes that can be reached from start."""
        front = np.array([start])
        seen[front] = True
        while len(front):
            ahead = np.unique(self.edges[front])
            front = ahead[(ahead >= 0) & ~seen[ahead]]
            seen[front] = True

    def reach_all(self) -> None:
        """One more edge a node: each node that searches can't reach hangs on the nearest one that they can and that has none yet."""
        if not len(self.points):
            return
        self.edges = np.concatenate([self.edges, np.full((len(self.points), 1), -1, np.int32)], 1)
        seen = np.zeros(len(self.points), bool)
        self.reached(self.entry, seen)
        while not seen.all():
            node = int(np.flatnonzero(~seen)[0])
            free = np.flatnonzero(seen & (self.edges[:, -1] < 0))
            self.edges[free[((self.points[free] - self.points[node]) ** 2).sum(1).argmin()], -1] = node
            self.reached(node, seen)


def nearest(graph: Graph, exact: np.ndarray, ids: list[np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of each query's k nearest of a shard: beams, then distances in double precision."""
    out_q, out_i, out_d = [], [], []
    for at in range(0, len(queries), BATCH):
        part = queries[at : at + BATCH]
        found, _ = graph.search(part.astype(np.float32), QUERY_BEAM)
        for q, vector, places in zip(query_ids[at : at + BATCH], part, found, strict=True):
            places = places[places >= 0]
            distance = np.sqrt(((exact[places] - vector) ** 2).sum(1))
            if len(places) > k + 1:  # all that tie with the last one stay: ids decide below
                near = distance <= np.partition(distance, k)[k]
                places, distance = places[near], distance[near]
            got_i = np.concatenate([ids[p] for p in places]) if len(places) else np.zeros(0, np.int64)
            got_d = np.repeat(distance, [len(ids[p]) for p in places])
            keep = got_i != q
            got_i, got_d = got_i[keep], got_d[keep]
            best = np.lexsort((got_i, got_d))[:k]
            out_q.append(np.full(len(best), q))
            out_i.append(got_i[best])
            out_d.append(got_d[best])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_i, np.int64), cat(out_d, np.float64)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is finite in every component and not zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


def usual_length(rows: DataFrame) -> int:
    """The most frequent length of the vectors (the lesser of two as frequent); 0 where there are none."""
    first = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return first.n if first else 0


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids, shard hash): each partition's distinct vectors (doubles, packed) with their k + 1 least ids.

    No answer needs more ids of one vector than that: a query's k nearest, and itself.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vector", "ids"])
            held.clear()
            return out

        for b in batches:
            flat = (b.column("v").flatten().to_numpy() + 0.0).reshape(len(b), -1) if len(b) else np.zeros((0, 1))
            for i, row in zip(b.column("id").to_pylist(), flat, strict=True):
                ids = held.setdefault(row.tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * (k + 1):
                    ids[:] = sorted(set(ids))[: k + 1]
            if len(held) > 50_000:
                yield flush()
        for ids in held.values():
            ids[:] = sorted(set(ids))[: k + 1]
        yield flush()

    return materialize(rows.mapInArrow(merge, "vector binary, ids array<long>"), "distinct-vectors")


def build_index(vectors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """One row per shard (its distinct vectors, their ids, the graph's edges and entry point; materialised), and their number.

    A shard without vectors has no row.
    """
    shards = max(1, round(vectors.count() / SHARD))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids: dict[bytes, set] = {}
        for vector, some in zip(table["vector"].to_pylist(), table["ids"].to_pylist(), strict=True):
            ids.setdefault(vector, set()).update(some)
        names = sorted(ids, key=lambda v: (min(ids[v]), v))
        exact = np.frombuffer(b"".join(names), np.float64).reshape(len(names), -1)
        lists = [np.array(sorted(ids[v])[: k + 1], np.int64) for v in names]
        graph = Graph.build(exact.astype(np.float32))
        binary = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"shard": [key[0].as_py()], "n": [len(names)], "entry": [graph.entry], "exact": binary(exact), "edges": binary(graph.edges), "ids": binary(np.concatenate(lists)), "counts": binary(np.array([len(x) for x in lists], np.int64))})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    return materialize(dealt.groupBy("shard").applyInArrow(tidy(build), "shard long, n long, entry long, exact binary, edges binary, ids binary, counts binary"), "graphs"), shards


def neighbours(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows of df but itself, by Euclidean distance.

    queries has the same columns as df. Ties among all vectors that a beam found go to the smaller id; identical vectors
    are all candidates. Rows without id, and vectors that are null, zero or not finite, take no part, as queries neither;
    nor do vectors of another length than most of df's, to which no distance is defined. A row that repeats an id counts
    once for equal vectors; an empty df or empty queries give no rows. Other columns are ignored, whatever their names.
    """
    arrow_batches(df.sparkSession, 1000)
    rows = usable(df, id_col, vector_col)
    alike = F.size("v") == usual_length(rows)
    index, shards = build_index(collapsed(rows.where(alike), k), k)
    asked = usable(queries, id_col, vector_col).where(alike).dropDuplicates(["id", "v"])
    total = asked.count()
    blocks = max(1, -(-total // BLOCK))
    parts = -(-blocks // TOGETHER)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        v = np.array(table["v"].to_pylist(), np.float64) + 0.0
        return pa.table({"block": [key[0].as_py()], "query_ids": pa.array([table["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "queries": pa.array([v.tobytes()], pa.binary())})

    packed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInArrow(pack, "block long, query_ids binary, queries binary")
    packed = materialize(packed, "query-blocks").withColumn("part", F.floor(F.col("block") / TOGETHER)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            row = left.to_pylist()[0]
            exact = np.frombuffer(row["exact"], np.float64).reshape(row["n"], -1)
            graph = Graph(exact.astype(np.float32), np.frombuffer(row["edges"], np.int32).reshape(row["n"], -1), row["entry"])
            ids = np.split(np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["counts"], np.int64))[:-1])
            for query_ids, vectors in zip(right["query_ids"].to_pylist(), right["queries"].to_pylist(), strict=True):
                query_ids = np.frombuffer(query_ids, np.int64)
                found.append(nearest(graph, exact, ids, query_ids, np.frombuffer(vectors, np.float64).reshape(len(query_ids), -1), k))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    hits = spread.groupBy("shard", "part").cogroup(packed.groupBy("shard", "part")).applyInArrow(tidy(search), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
