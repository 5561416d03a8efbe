"""K-means on integer vectors whose candidate centroids are filtered by N-simplex projection."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.sources.scratch import materialize

COMPONENTS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 27  # of a component's amount: squared distances then fit in 64 bits
SLACK = 1e-5  # of the bounds, far above their rounding errors
BATCH_ROWS = 1 << 13


class Simplex:
    """Pivots as corners of a simplex, and the apex that distances to them give.

    The base has its first corner at the origin and each further one in one more
    dimension. A vector is the apex over it: one coordinate per dimension of the
    base, and the height above it. Two vectors are at least as far apart as their
    apexes on the same side of the base, and at most as far as on opposite sides.
    Of ``pivots`` those that hardly leave the base of the others are not corners.
    """

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots, self.used, self.corners = pivots, [0], np.zeros((1, 0))
        for number in range(1, len(pivots)):
            squares = squared(pivots[number : number + 1], pivots[self.used]).astype(np.float64)
            apex = apexes(squares, self.corners)[0]
            if apex[-1] ** 2 > 1e-4 * squares.max():
                self.corners = np.vstack([np.hstack([self.corners, np.zeros((len(self.corners), 1))]), apex])
                self.used.append(number)

    def apex(self, squares: np.ndarray) -> np.ndarray:
        """The apex of each vector, from its squared distances to all pivots."""
        return apexes(squares[:, self.used].astype(np.float64), self.corners)


def squared(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to a few others."""
    return np.stack([((vectors - o) ** 2).sum(axis=1) for o in others], axis=1)


def apexes(squares: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Coordinates over the base and the height, from squared distances to its corners."""
    base = corners[1:]
    along = (squares[:, :1] + (base**2).sum(axis=1) - squares[:, 1:]) / 2
    at = np.linalg.solve(base, along.T).T if len(base) else along
    height = np.sqrt(np.maximum(0, squares[:, 0] - (at**2).sum(axis=1)))
    return np.column_stack([at, height])


def nearest(vectors: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray):
    """Each vector's nearest centroid, its squared distance, and how many distances that took.

    Exact integer distances are taken only to centroids whose lower bound does not
    pass the least upper bound; of equally near ones the smaller number is taken.
    """
    flat = ((apex[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(axis=2)
    lower = flat + (apex[:, None, -1] - tops[None, :, -1]) ** 2
    upper = flat + (apex[:, None, -1] + tops[None, :, -1]) ** 2
    size = (apex**2).sum(axis=1)[:, None] + (tops**2).sum(axis=1)[None] + 1
    left = lower - SLACK * size <= (upper + SLACK * size).min(axis=1)[:, None]
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    cluster = np.full(len(vectors), -1)
    for number in range(len(centroids)):
        rows = np.flatnonzero(left[:, number])
        distance = ((vectors[rows] - centroids[number]) ** 2).sum(axis=1)
        nearer = (distance < best[rows]) | (cluster[rows] < 0)
        best[rows[nearer]], cluster[rows[nearer]] = distance[nearer], number
    return cluster, best, int(left.sum())


def integer_vectors(table: DataFrame, components: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``, the integers of each vector that takes part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LARGEST))
    kept = table.where((F.size("embedding") == components) & good)
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), width or len(values) // len(column))


def lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.reshape(-1)))


def cluster_vectors(
    table: DataFrame,
    clusters: int = CENTROIDS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = 1,
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors need exactly ``components`` components, none null or non-finite; ``floor(scale
    * x)`` makes integers of them. Those with an amount of 2**27 or more there, whose
    squared distances no long holds, take no part either. Centroids start as the vectors
    with the smallest SHA-256 of ``seed:vec_id``; null ids come last, and rows that share
    an id go by their components. With fewer vectors than ``clusters`` each is a centroid;
    an empty table gives no rows. Rows that share an id are vectors of their own.

    Every vector's distances to the pivots are computed once and written beside it.
    Pivots are the first centroids, and after one round those that it gave as well,
    since later ones lie near their span, where the bounds are tight. A round reads that
    table, filters centroids by the bounds of the apexes, compares the rest exactly,
    and sends sums per task; the driver holds ``clusters`` vectors and their sums. All
    decisions are made on integers.
    """
    kept = integer_vectors(table.select("vec_id", "embedding"), components, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(digest.asc_nulls_last(), "v").limit(clusters).collect()
    kind = dict(kept.dtypes)["vec_id"]
    out = f"vec_id {kind}, cluster int, distance bigint"
    if not start:
        empty = kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")])
        return empty.withColumn("centroid_sha256", F.lit(""))
    centroids = np.array([r.v for r in start], np.int64)

    def measured(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
        """The table with the distances to more pivots behind those it has."""

        def measure(batches):
            for batch in pieces(batches):
                more = squared(matrix(batch["v"], components), pivots)
                if "squares" in batch.schema.names:
                    more = np.hstack([matrix(batch["squares"]), more])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], lists(more)], ["vec_id", "v", "squares"])

        return materialize(rows.mapInArrow(measure, f"vec_id {kind}, v array<bigint>, squares array<bigint>"), "pivots")

    def assigned(batch, simplex, centroids):
        apex = simplex.apex(matrix(batch["squares"]))
        tops = simplex.apex(squared(centroids, simplex.pivots))
        vectors = matrix(batch["v"], components)
        return vectors, *nearest(vectors, apex, centroids, tops)

    def sums(cached: DataFrame, simplex: Simplex, centroids: np.ndarray):
        def add(batches):
            total = np.zeros((len(centroids), components + 1), np.int64)
            for batch in pieces(batches):
                vectors, cluster, _, _ = assigned(batch, simplex, centroids)
                np.add.at(total, cluster, np.column_stack([vectors, np.ones(len(vectors), np.int64)]))
            used, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[used, at])], ["cluster", "at", "total"]
            )

        parts = cached.select("v", "squares").mapInArrow(add, "cluster int, at int, total bigint")
        return parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()

    simplex = Simplex(centroids)
    cached = measured(kept, centroids)
    for number in range(rounds):
        total = [[0] * (components + 1) for _ in range(len(centroids))]
        for row in sums(cached, simplex, centroids):
            total[row.cluster][row["at"]] = int(row.total)
        moved = [[x // t[-1] for x in t[:-1]] if t[-1] else c for t, c in zip(total, centroids.tolist())]
        centroids = np.array(moved, np.int64)
        if number == 0:
            simplex = Simplex(np.vstack([simplex.pivots, centroids]))
            cached = measured(cached, centroids)

    def assign(batches):
        for batch in pieces(batches):
            _, cluster, distance, _ = assigned(batch, simplex, centroids)
            columns = [batch["vec_id"], pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    done = materialize(cached.mapInArrow(assign, out), "assigned")
    totals = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = totals.withColumn("inertia", F.lit(sum(r.cluster_inertia for r in totals.collect())).cast("bigint"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = totals.withColumn("centroid_sha256", F.get(F.lit(names), "cluster"))
    return done.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_centroids(spark, sf_dir):
    """Cluster, distance and inertia of every vector of ``embeddings``."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """The same by three unrolled rounds in SQL."""
    squared = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        f"""WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {COMPONENTS}
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {COMPONENTS}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v
    FROM v ORDER BY sha256('1:' || vec_id) LIMIT {CENTROIDS}
)"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""d{i} AS MATERIALIZED (
    SELECT vec_id, v.v, cluster, {squared} AS distance FROM v CROSS JOIN c{i} AS c
), a{i} AS MATERIALIZED (
    SELECT vec_id, v, cluster, distance FROM d{i}
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
)""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (
    SELECT cluster, place, sum(x) AS total, count(*) AS n
    FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {COMPONENTS + 1})) AS place FROM a{i})
    GROUP BY cluster, place
), m{i} AS (
    SELECT cluster, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY place) AS v FROM s{i} GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster)
)""")
    return ",\n".join(parts) + f"""
SELECT
    vec_id,
    a.cluster::INTEGER AS cluster,
    distance,
    sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON a.cluster = c.cluster
"""


OP13_SQL = oracle()
