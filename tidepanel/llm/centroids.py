"""Centroid clustering with lower bounds that geometry loosens by less than the full drift.

Vectors carry their cluster and a lower bound of their distance to every other
centroid. When centroids move, the vectors of a cluster all lie in a sphere
around its old centroid. How much nearer a moved centroid can have come to any
point of that sphere is a question in the plane through the sphere's centre and
the centroid's two places: points that gained at least 2A on the way lie inside
one branch of a hyperbola with those places as foci, hence inside the cone of its
asymptotes, and the sphere reaches into the cone only so far. The bound is
loosened by that gain, which is at most the drift and often nothing. A vector
whose distance to its own centroid stays below its bound keeps its cluster; the
others are ambiguous and scanned against all centroids.

Vectors are integers, so distances are exact; bounds are doubles and give way by
`SLACK` to cover their rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64.0, "1"
#: Relative and absolute rounding that bounds allow for.
SLACK = 1e-9
#: Components beyond would not leave a squared distance within a long.
REACH = 1 << 27
ROWS = 4096


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with `dimensions` components, none null or non-finite; v = floor(scale * x) as long."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    small = F.forall("embedding", lambda x: F.abs(F.floor(F.lit(scale) * x.cast("double"))) < F.lit(REACH))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.size("embedding") == dimensions).where(finite)
    return rows.select("vec_id", F.when(small, whole).otherwise(F.raise_error(F.lit("a component is too large for distances in a long"))).alias("v"))


def seeds(points: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors whose `seed:vec_id` has the smallest SHA-256, in that order; of a repeated id the smaller vector first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.where("vec_id IS NOT NULL").orderBy(order, "v").limit(clusters).collect()
    return np.array([r.v for r in first], np.int64)


def gains(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: at most so much nearer has centroid j come to any point within radius[i] of old centroid i."""
    step = (new - old).astype(np.float64)
    drift = np.sqrt((step * step).sum(axis=1))
    away = old[:, None, :] - (old + new)[None, :, :] / 2.0  # from the middle of j's way to centre i
    length = np.sqrt((away * away).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.clip((away * step[None]).sum(axis=2) / (length * drift[None]), -1.0, 1.0)
        reach = np.arcsin(np.clip(radius[:, None] / length, 0.0, 1.0))
    angle = np.maximum(np.arccos(cosine) - reach, 0.0)
    gain = drift[None] * np.maximum(np.cos(angle), 0.0)
    gain = np.where((radius[:, None] >= length) | ~np.isfinite(gain), drift[None], gain)
    return np.minimum(gain * (1 + SLACK) + SLACK, drift[None] * (1 + SLACK) + SLACK) * (drift > 0)[None]


def squares(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scan(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid (ties: smaller number), its squared distance, and the distance to the next."""
    all_of = squares(rows, centroids)
    cluster = all_of.argmin(axis=1)
    at = np.arange(len(rows))
    best = all_of[at, cluster]
    if len(centroids) == 1:
        return cluster, best, np.full(len(rows), np.inf)
    all_of[at, cluster] = np.iinfo(np.int64).max
    return cluster, best, np.sqrt(all_of.min(axis=1).astype(np.float64)) * (1 - SLACK)


def assigned(points: DataFrame, centroids: np.ndarray, loosen: np.ndarray | None = None) -> DataFrame:
    """(vec_id, v, cluster, distance, bound, scanned) under `centroids`.

    With `loosen`, by cluster, `points` has the cluster and bound of the round
    before and only ambiguous vectors are scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
                if loosen is None:
                    cluster, distance, bound = scan(rows, centroids)
                    scanned = np.ones(len(rows), bool)
                else:
                    cluster = batch["cluster"].to_numpy().astype(np.int64)
                    bound = batch["bound"].to_numpy() - loosen[cluster]
                    distance = ((rows - centroids[cluster]) ** 2).sum(axis=1)
                    scanned = np.sqrt(distance.astype(np.float64)) * (1 + SLACK) + SLACK >= bound
                    if scanned.any():
                        cluster[scanned], distance[scanned], bound[scanned] = scan(rows[scanned], centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["v"], pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(bound), pa.array(scanned)],
                    ["vec_id", "v", "cluster", "distance", "bound", "scanned"])

    return points.mapInArrow(run, "vec_id long, v array<long>, cluster int, distance long, bound double, scanned boolean")


def moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids as floors of their vectors' means (empty ones stay), and the radius of each cluster around the old ones."""
    sums = [F.sum(F.col("v")[d].cast("decimal(19, 0)")).alias(f"s{d}") for d in range(centroids.shape[1])]
    radius = np.zeros(len(centroids))
    new = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():
        new[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(centroids.shape[1])]
        radius[r.cluster] = np.sqrt(float(r.far)) * (1 + SLACK) + SLACK
    return new, radius


def loosened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the largest gain of any other centroid over its sphere."""
    gain = gains(old, new, radius)
    np.fill_diagonal(gain, 0.0)
    return gain.max(axis=1, initial=0.0)


def rounds(points: DataFrame, start: np.ndarray, count: int = ROUNDS) -> Iterator[tuple[DataFrame, np.ndarray]]:
    """The written assignment and its centroids, before the first move and after each; a round's table goes when the next is asked for."""
    state, path = written(assigned(points, start), "assigned")
    centroids = start
    yield state, centroids
    for _ in range(count):
        new, radius = moved(state, centroids)
        following, next_path = written(assigned(state, new, loosened(centroids, new, radius)), "assigned")
        discard(points.sparkSession, path)
        state, path, centroids = following, next_path, new
        yield state, centroids


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, count: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of (vec_id, embedding).

    Vectors of another length, null, or with a null or non-finite component take no
    part. Repeated rows each count; a row with a null vec_id is assigned but is no
    starting centroid. With fewer vectors than clusters there are as many clusters
    as vectors with an id; without any, no rows. Ties go to the smaller number. A
    component of 2^27 or more after scaling is an error, since distances would
    leave the long range.
    """
    points = kept(vectors, dimensions, scale)
    start = seeds(points, clusters)
    if not len(start):
        return points.where("false").select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for state, last in rounds(points, start, count):
        centroids = last
    sums = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = F.array(*(F.lit(sums.get(i, 0)).cast("long") for i in range(len(centroids))))
    return state.select(
        "vec_id", "cluster", "distance", of_cluster[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.array(*map(F.lit, digests))[F.col("cluster")].alias("centroid_sha256"))
