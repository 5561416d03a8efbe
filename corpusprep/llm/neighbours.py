"""Approximate nearest neighbours: a robust-pruned directed graph for each shard."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.sources.scratch import materialize

DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
RELAXATION = 1.2  # a neighbour is dropped if a kept one is so many times closer to it
SHARD_ROWS = 50_000
LEAST_SHARDS = 8
BATCH = 256  # nodes or queries that move through the graph together


class Graph(NamedTuple):
    """Distinct vectors, their ids (ascending, ``ids[first[i]:first[i+1]]``) and edges (-1: none)."""

    vectors: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    edges: np.ndarray
    entry: int


def beam(vectors: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int):
    """Greedy search with a bounded list, for many queries in step: (nodes, squared distances).

    Each step expands the nearest unexpanded node of every query's list, until all
    nodes in the list are expanded. Lists are ascending; -1 and inf fill them up.
    """
    n = len(queries)
    nodes, near = np.full((n, width), -1), np.full((n, width), np.inf)
    nodes[:, 0], near[:, 0] = entry, ((queries - vectors[entry]) ** 2).sum(axis=1)
    expanded, seen = np.zeros((n, width), bool), np.zeros((n, len(vectors)), bool)
    seen[:, entry] = True
    while True:
        open_nodes = ~expanded & (nodes >= 0)
        active = np.flatnonzero(open_nodes.any(axis=1))
        if not len(active):
            return nodes, near
        at = open_nodes[active].argmax(axis=1)
        expanded[active, at] = True
        found = edges[nodes[active, at]]
        fresh = (found >= 0) & ~seen[active[:, None], found]
        seen[np.repeat(active, fresh.sum(axis=1)), found[fresh]] = True
        gap = vectors[found] - queries[active][:, None, :]
        distance = np.where(fresh, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
        all_near = np.concatenate([near[active], distance], axis=1)
        order = np.argsort(all_near, axis=1, kind="stable")[:, :width]
        near[active] = np.take_along_axis(all_near, order, 1)
        all_nodes = np.concatenate([nodes[active], np.where(fresh, found, -1)], axis=1)
        nodes[active] = np.take_along_axis(all_nodes, order, 1)
        done = np.concatenate([expanded[active], np.zeros(found.shape, bool)], axis=1)
        expanded[active] = np.take_along_axis(done, order, 1)


def prune(vectors: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: the nearest candidate stays and drops those much nearer to it, and so on."""
    own = vectors[of]
    points = vectors[candidates]
    gap = points - own[:, None, :]
    distance = np.where((candidates >= 0) & (candidates != of[:, None]), np.einsum("ijk,ijk->ij", gap, gap), np.inf)
    order = np.argsort(distance, axis=1, kind="stable")[:, : 3 * degree]
    candidates = np.take_along_axis(candidates, order, 1)
    distance = np.take_along_axis(distance, order, 1)
    points = np.take_along_axis(points, order[:, :, None], 1)
    norms = np.einsum("ijk,ijk->ij", points, points)
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    alive = np.isfinite(distance)
    kept = np.full((len(of), degree), -1)
    rows = np.arange(len(of))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        kept[some, k] = candidates[rows, at][some]
        covered = RELAXATION**2 * between[rows, at] <= distance
        alive &= ~covered
        alive[rows, at] = False
    return kept


def build(vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Insert nodes in growing batches: search, prune, link back. Every node is reachable."""
    n = len(vectors)
    middle = vectors.mean(axis=0)
    entry = int(((vectors - middle) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, max(1, at // 4))]
        at += len(batch)
        nodes, _ = beam(vectors, edges, entry, vectors[batch], width)
        edges[batch] = prune(vectors, batch, nodes, degree)
        source = np.repeat(batch, degree)
        target = edges[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        heads, starts, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(starts, counts)
        incoming = np.full((len(heads), int(counts.max(initial=0))), -1)
        incoming[np.repeat(np.arange(len(heads)), counts), place] = source
        every = np.concatenate([edges[heads], incoming], axis=1)
        size = (every >= 0).sum(axis=1)
        full = size > degree
        if (~full).any():
            packed = np.sort(every[~full], axis=1)[:, ::-1][:, :degree]
            edges[heads[~full], : packed.shape[1]] = packed
        for some in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // BATCH))):
            if len(some):
                edges[heads[some]] = prune(vectors, heads[some], every[some], degree)
    return reach_all(vectors, edges, entry), entry


def reach_all(vectors: np.ndarray, edges: np.ndarray, entry: int) -> np.ndarray:
    """Link nodes that no path from the entry reaches to their nearest reached node."""
    while True:
        reached = np.zeros(len(vectors), bool)
        reached[entry], front = True, np.array([entry])
        while len(front):
            front = np.unique(edges[front])
            front = front[(front >= 0)]
            front = front[~reached[front]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return edges
        inside = np.flatnonzero(reached)
        nearest = inside[((vectors[inside] - vectors[lost[0]]) ** 2).sum(axis=1).argmin()]
        if (edges[nearest] >= 0).all():
            edges = np.concatenate([edges, np.full((len(edges), 1), -1)], axis=1)
        edges[nearest, np.flatnonzero(edges[nearest] < 0)[0]] = lost[0]


def index_shard(ids: np.ndarray, vectors: np.ndarray) -> Graph:
    order = np.lexsort((ids,))
    ids = ids[order]
    distinct, group = np.unique(vectors[order] + 0.0, axis=0, return_inverse=True)  # -0.0 equals 0.0
    member = np.argsort(group.reshape(-1), kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(group.reshape(-1)))))
    edges, entry = build(distinct.astype(np.float32))
    return Graph(distinct, ids[member], first, edges, entry)


def search(graph: Graph, ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> pd.DataFrame:
    """The ``k`` nearest found of every query, except rows with the query's own id."""
    out = []
    light = graph.vectors.astype(np.float32)
    for at in range(0, len(ids), BATCH):
        some = queries[at : at + BATCH]
        nodes, _ = beam(light, graph.edges, graph.entry, some.astype(np.float32), max(width, 2 * k))
        for row, own, query in zip(nodes, ids[at : at + BATCH], some):
            row = row[row >= 0]
            distance = np.sqrt(((graph.vectors[row] - query) ** 2).sum(axis=1))
            found = [graph.ids[graph.first[i] : min(graph.first[i] + k + 1, graph.first[i + 1])] for i in row]
            sizes = [len(f) for f in found]
            near, other = np.repeat(distance, sizes), np.concatenate(found)
            keep = other != own
            near, other = near[keep], other[keep]
            best = np.lexsort((other, near))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": other[best], "score": near[best]}))
    return pd.concat(out, ignore_index=True)


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not zero and has only finite components."""
    vector = F.col("vector")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & vector.isNotNull() & finite & some)


def vectors_of(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<f8").reshape(-1, dim)


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> tuple[DataFrame, int]:
    """One row per shard and dimension with its graph, and the number of shards.

    Rows are dealt by a hash of their id, so equal vectors, however many, spread
    over all shards; inside a shard they are one node.
    """
    count = rows.count()
    shards = max(least_shards, -(-count // shard_rows))

    def index(group: pd.DataFrame) -> pd.DataFrame:
        graph = index_shard(group["vec_id"].to_numpy(), np.array(group["vector"].tolist(), float))
        return pd.DataFrame(
            {
                "dim": [graph.vectors.shape[1]],
                "shard": [int(group["shard"].iloc[0])],
                "vectors": [graph.vectors.astype("<f8").tobytes()],
                "ids": [graph.ids.astype("<i8").tobytes()],
                "first": [graph.first.astype("<i8").tobytes()],
                "edges": [graph.edges.astype("<i4").tobytes()],
                "entry": [graph.entry],
            }
        )

    dealt = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        "vector",
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64(F.col("vec_id").cast("bigint")), F.lit(shards)).cast("int").alias("shard"),
    )
    schema = "dim int, shard int, vectors binary, ids binary, first binary, edges binary, entry int"
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(index, schema), "graphs"), shards


def one_per_id(queries: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` and ``dim``; of rows with one id the smallest vector asks."""
    one = queries.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("vector").alias("vector"))
    return one.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))


def open_graph(row) -> Graph:
    dim = int(row["dim"])
    n = len(row["vectors"]) // (8 * dim)
    return Graph(
        vectors_of(row["vectors"], dim),
        np.frombuffer(row["ids"], "<i8"),
        np.frombuffer(row["first"], "<i8"),
        np.frombuffer(row["edges"], "<i4").reshape(n, -1).astype(np.int64),
        int(row["entry"]),
    )


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    width: int = SEARCH_BEAM,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` from ``rows`` and ``queries`` (vec_id, vector).

    All rows are indexed. A shard's task reads its graph once and then streams all
    queries of that dimension past it; the results are merged. Scores are Euclidean distances of the given vectors in
    double precision; ties go to the smaller id. Vectors of another dimension, null,
    zero or not finite ones and null ids take no part. Rows repeated with an id
    count once, at their nearest vector.
    """
    graphs, shards = build_index(usable(rows), shard_rows)
    # Ids have no nulls beside them, since pandas would turn them into doubles.
    graphs = graphs.withColumns({"vec_id": F.lit(0).cast("bigint"), "asks": F.lit(False)})
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = one_per_id(usable(queries)).select("*", F.lit(True).alias("asks"), each_shard)

    def look(batches):
        graph, of = None, None
        for batch in batches:
            for (dim, shard), rows in batch.groupby(["dim", "shard"], sort=True):
                if not rows["asks"].iloc[0]:  # the graph comes before its queries
                    graph, of, rows = open_graph(rows.iloc[0]), (dim, shard), rows.iloc[1:]
                if of != (dim, shard):  # no rows of that dimension in the shard
                    continue
                for at in range(0, len(rows), BATCH):
                    some = rows.iloc[at : at + BATCH]
                    vectors = np.array(some["vector"].tolist(), float)
                    yield search(graph, some["vec_id"].to_numpy(np.int64), vectors, k, width)

    # A partition is a shard: its graphs sort before the queries that stream past.
    stream = graphs.unionByName(asked, allowMissingColumns=True)
    stream = stream.repartitionById(shards, "shard").sortWithinPartitions("dim", "asks", "vec_id")
    found = stream.mapInPandas(look, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark, sf_dir):
    """The ten nearest rows of every hundredth vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(100)) == 0))
