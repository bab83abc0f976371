"""Approximate nearest neighbours with a robust-pruned directed graph per shard.

Vectors are dealt into shards of bounded size by a hash. In each shard points enter
the graph in growing batches: a greedy search from the middle of the shard proposes
neighbours, pruning keeps a candidate only if no kept one is closer to it by the factor
``alpha``, so that edges stay diverse, and edges are made both ways. A beam search asks
every shard for each query; the best of all shards are the answer.

Equal vectors are one point of the graph, which carries the few smallest ids an answer can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.session import materialize


@dataclass(frozen=True)
class Settings:
    """``degree``: edges of a point at most; ``build`` and ``beam``: candidates a search keeps while building and asking."""

    degree: int = 32
    build: int = 64
    beam: int = 128
    alpha: float = 1.2
    shard_rows: int = 5000


def _squared(points: np.ndarray, norms: np.ndarray, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squared distances from each query to its own rows (queries x rows)."""
    products = np.matmul(points[rows], query[:, :, None])[:, :, 0]
    return norms[rows] - 2 * products + (query**2).sum(axis=1)[:, None]


def beam_search(
    points: np.ndarray, norms: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` closest points found for each query, all queries a step at a time; -1 where fewer are found.

    ``edges`` holds the neighbours of each point, filled up with -1.
    """
    many, size = len(queries), len(points)
    row = np.arange(many)[:, None]
    seen = np.zeros((many, size + 1), bool)
    seen[:, -1] = True  # -1: no point
    seen[:, start] = True
    beam = np.full((many, width), -1)
    far = np.full((many, width), np.inf)
    beam[:, 0] = start
    far[:, :1] = _squared(points, norms, beam[:, :1], queries)
    done = np.zeros((many, width), bool)
    while True:
        waiting = np.where(done | (beam < 0), np.inf, far)
        best = waiting.argmin(axis=1)
        active = np.flatnonzero(waiting[row[:, 0], best] < np.inf)
        if not len(active):
            return beam, far
        best = best[active]
        done[active, best] = True
        proposed = edges[beam[active, best]]
        fresh = ~seen[active[:, None], proposed]
        seen[active[:, None], proposed] = True
        seen[:, -1] = True
        proposed = np.where(fresh, proposed, -1)
        distance = np.where(fresh, _squared(points, norms, proposed, queries[active]), np.inf)
        together = np.concatenate([far[active], distance], axis=1)
        order = np.argpartition(together, width - 1, axis=1)[:, :width]
        far[active] = np.take_along_axis(together, order, axis=1)
        beam[active] = np.take_along_axis(np.concatenate([beam[active], proposed], axis=1), order, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros_like(fresh)], axis=1), order, axis=1)


def robust_prune(
    points: np.ndarray, norms: np.ndarray, at: np.ndarray, candidates: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """Neighbours of each point of ``at`` out of its candidates (-1: none), nearest first, each far from those before it."""
    distance = np.where(candidates >= 0, _squared(points, norms, candidates, points[at]), np.inf)
    distance[candidates == at[:, None]] = np.inf
    kept = np.full((len(at), degree), -1)
    row = np.arange(len(at))
    alive = distance.copy()
    for place in range(degree):
        nearest = alive.argmin(axis=1)
        left = alive[row, nearest] < np.inf
        if not left.any():
            break
        chosen = candidates[row, nearest]
        kept[left, place] = chosen[left]
        between = _squared(points, norms, candidates, points[np.where(left, chosen, 0)])
        alive[left[:, None] & (alpha**2 * between <= distance)] = np.inf
        alive[row, nearest] = np.inf
    return kept


def _with_back_edges(points, norms, edges, sources: np.ndarray, degree: int, alpha: float) -> None:
    """Each new neighbour gets an edge back; where that makes too many, they are pruned."""
    target = edges[sources].ravel()
    source = np.repeat(sources, edges.shape[1])[target >= 0]
    target = target[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    touched, first, counts = np.unique(target, return_index=True, return_counts=True)
    for begin in range(0, len(touched), 256):
        part = slice(begin, begin + 256)
        extra = np.full((len(touched[part]), counts[part].max()), -1)
        inside = np.arange(extra.shape[1])[None, :] < counts[part][:, None]
        extra[inside] = source[first[part][0] : first[part][-1] + counts[part][-1]]
        old = edges[touched[part]]
        extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        wanted = np.concatenate([old, extra], axis=1)
        fits = (wanted >= 0).sum(axis=1) <= degree
        packed = np.take_along_axis(wanted, np.argsort(wanted < 0, axis=1, kind="stable"), axis=1)[:, :degree]
        pruned = robust_prune(points, norms, touched[part][~fits], wanted[~fits], degree, alpha)
        edges[touched[part][fits]] = packed[fits]
        edges[touched[part][~fits]] = pruned


def build_graph(points: np.ndarray, settings: Settings, seed: int = 5) -> tuple[np.ndarray, int]:
    """Neighbours of every point (points x degree, -1: none) and the point searches start from."""
    size = len(points)
    norms = (points**2).sum(axis=1)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((size, settings.degree), -1)
    order = np.random.default_rng(seed).permutation(size)
    order = order[order != start]
    at = 0
    while at < len(order):
        batch = order[at : at + min(max(at, 1), 256)]
        found, _ = beam_search(points, norms, edges, start, points[batch], settings.build)
        edges[batch] = robust_prune(points, norms, batch, found, settings.degree, settings.alpha)
        _with_back_edges(points, norms, edges, batch, settings.degree, settings.alpha)
        at += len(batch)
    return edges, start


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


_INDEX = "shard long, kind int, place int, id long, vector array<double>, ids array<long>, edges array<int>, start int"


def _build(settings: Settings):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(rows["vector"].to_numpy()).astype(float)
        edges, start = build_graph(points, settings)
        return pd.DataFrame(
            {"shard": rows["shard"], "kind": 0, "place": np.arange(len(rows)), "id": None, "vector": rows["vector"],
             "ids": rows["ids"], "edges": [row[row >= 0] for row in edges], "start": start}
        )

    return run


def index(vectors: DataFrame, k: int, settings: Settings, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """A stored table of graph points, and the number of shards per dimension.

    Rows without key or with unusable vectors are left out. Of rows with the same vector the
    ``k + 1`` smallest keys are kept, as many as an answer can hold besides the query's own.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    points = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    points = points.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = materialize(points, "points")
    shards = max(1, -(-points.count // settings.shard_rows))
    # Vectors of different length cannot be compared: each dimension has shards of its own.
    shard = F.size("vector") * F.lit(shards).cast("long") + F.pmod(F.xxhash64("vector"), F.lit(shards))
    built = points.rows.withColumn("shard", shard).groupBy("shard").applyInPandas(_build(settings), _INDEX)
    return materialize(built, "graph").rows, shards


def _search(k: int, settings: Settings):
    """Rows sorted by shard, points before queries: a shard's graph is held, queries stream past it."""

    def answers(graph, batch: pa.RecordBatch) -> pa.RecordBatch:
        points, norms, edges, start, ids = graph
        query_ids = batch.column("id").to_numpy()
        flat = batch.column("vector").flatten().to_numpy()
        queries = flat.reshape(len(query_ids), -1)
        out: list[tuple[int, int, float]] = []
        for begin in range(0, len(queries), 128):
            part, own = queries[begin : begin + 128], query_ids[begin : begin + 128]
            found, _ = beam_search(points, norms, edges, start, part, min(settings.beam, len(points)))
            exact = np.sqrt(((points[found] - part[:, None, :]) ** 2).sum(axis=2))
            exact[found < 0] = np.inf
            for i in range(len(part)):
                best = sorted((exact[i, j], id_) for j in _least(exact[i], k + 1) for id_ in ids[found[i, j]] if id_ != own[i])
                out += [(own[i], id_, score) for score, id_ in best[:k]]
        columns = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph, pending = None, None, []
        for batch in batches:
            while batch.num_rows:
                first = (batch.column("shard")[0].as_py(), batch.column("kind")[0].as_py())
                same = (batch.column("shard").to_numpy() == first[0]) & (batch.column("kind").to_numpy() == first[1])
                here = len(same) if same.all() else int(same.argmin())
                part, batch = batch.slice(0, here), batch.slice(here)
                if first[0] != shard:
                    shard, graph, pending = first[0], None, []
                if first[1] == 0:
                    pending.append(part)
                elif pending:
                    if graph is None:
                        graph = _graph(pending, settings.degree)
                    yield answers(graph, part)

    return run


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values that are finite, and of those equal to the last of them."""
    finite = np.flatnonzero(values < np.inf)
    if len(finite) <= n:
        return finite
    return finite[values[finite] <= np.partition(values[finite], n - 1)[n - 1]]


def _graph(parts: list[pa.RecordBatch], degree: int):
    table = pa.Table.from_batches(parts).sort_by("place")
    points = table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    edges = np.full((table.num_rows, degree), -1)
    for row, ends in enumerate(table.column("edges").to_pylist()):
        edges[row, : len(ends)] = ends
    return points, (points**2).sum(axis=1), edges, table.column("start")[0].as_py(), table.column("ids").to_pylist()


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", settings: Settings | None = None
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest found by Euclidean distance, ties to smaller ids.

    Rows of the query's own id are no candidates. Null, zero and non-finite vectors and rows without
    an id take no part, as queries or candidates; a query meets vectors of its own length only and
    gets all candidates if they are fewer than k. Repeated rows count once; an id with several vectors has each of
    them as a candidate and, as a query, asks with each. Empty tables give no rows; other columns are ignored.
    """
    settings = settings or Settings()
    points, shards = index(vectors, k, settings, key, vector)
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = asked.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    first = F.size("vector") * F.lit(shards).cast("long")
    asked = asked.select(
        F.explode(F.sequence(first, first + (shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("place"), "id", "vector",
        F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("edges"), F.lit(0).alias("start"),
    )
    together = points.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = together.mapInArrow(_search(k, settings), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
