"""Centroid clustering of integer vectors with Hamerly's bounds.

A vector keeps two bounds on its distances, from round to round in the written table: ``upper`` on that to its own centroid,
``lower`` on that to the nearest other one. When centroids move, upper grows by the drift of its own centroid and lower
shrinks by the largest drift of the others. While upper stays below lower (or below half the distance from its centroid to
the next one) no other centroid can be as near, so the vector isn't looked at. Else its own distance is computed, and
where that doesn't decide either, the distances to all centroids, in whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.shared import NULL_ID, discard, scratch, table, written

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: By so much, in parts, bounds are loosened: more than the rounding of square roots and sums adds up to.
SLACK = 1e-9


def whole_vector(vector: Column, dims: int = DIMS) -> Column:
    """floor(SCALE * x) of each component; null unless there are ``dims`` components, all finite."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when((F.size(vector) == dims) & fine, whole)


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """[row, centroid]: exact squares of distances; by floating-point products where all terms are whole numbers below 2^53."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, rows.shape[1]) < 1 << 53 else np.int64
    x, c = rows.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def full_scan(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number) and its bounds from whole-number distances."""
    d = squared_distances(rows, centroids)
    own, at = d.argmin(1), np.arange(len(d))
    upper = np.sqrt(d[at, own].astype(np.float64)) * (1 + SLACK)
    d[at, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) if d.shape[1] > 1 else np.full(len(d), np.inf)
    return own, upper, lower


def moved(rows: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment and bounds after the centroids moved from ``before``; and how many rows needed a full scan."""
    k = len(centroids)
    drift = np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
    others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(k)])
    between = squared_distances(centroids, centroids).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    half = np.sqrt(between.min(1)) / 2 * (1 - SLACK)
    own, upper, lower = own.copy(), (upper + drift[own]) * (1 + SLACK), np.maximum(lower - others[own], 0) * (1 - SLACK)
    open_rows = np.flatnonzero(upper >= np.maximum(lower, half[own]))
    if len(open_rows):
        exact = ((rows[open_rows] - centroids[own[open_rows]]) ** 2).sum(1)
        upper[open_rows] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
        open_rows = open_rows[upper[open_rows] >= np.maximum(lower[open_rows], half[own[open_rows]])]
    if len(open_rows):
        own[open_rows], upper[open_rows], lower[open_rows] = full_scan(rows[open_rows], centroids)
    return own, upper, lower, len(open_rows)


def assigned(state: DataFrame, before: np.ndarray | None, centroids: np.ndarray) -> DataFrame:
    """``state`` (vec_id, vec, cluster, upper, lower) with the nearest of ``centroids``; ``before`` None: no bounds are known."""

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            rows = np.stack(pdf["vec"].tolist()).astype(np.int64)
            if before is None:
                own, upper, lower = full_scan(rows, centroids)
            else:
                own, upper, lower, _ = moved(rows, pdf["cluster"].to_numpy(np.int64), pdf["upper"].to_numpy(), pdf["lower"].to_numpy(), before, centroids)
            yield pdf.assign(cluster=own.astype(np.int32), upper=upper, lower=lower)

    return state.mapInPandas(run, "vec_id long, vec array<long>, cluster int, upper double, lower double")


def partial_sums(batches):
    """Batches of (cluster, vec) -> (cluster, n, place, total): a batch's rows and sums of each component."""
    for pdf in batches:
        if pdf.empty:
            continue
        rows, own = np.stack(pdf["vec"].tolist()).astype(np.int64), pdf["cluster"].to_numpy(np.int64)
        there, at = np.unique(own, return_inverse=True)
        sums = np.zeros((len(there), rows.shape[1]), dtype=np.int64)
        np.add.at(sums, at, rows)
        places = np.tile(np.arange(rows.shape[1], dtype=np.int32), len(there))
        yield pd.DataFrame({"cluster": np.repeat(there, rows.shape[1]), "n": np.repeat(np.bincount(at), rows.shape[1]), "place": places, "total": sums.ravel()})


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster; an empty one keeps its centroid. A row for each component of each cluster is collected."""
    parts = state.select("cluster", "vec").mapInPandas(partial_sums, "cluster long, n long, place int, total long")
    out = centroids.copy()
    for row in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(19,0)")).alias("total")).collect():
        out[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return out


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` (vec_id: long, NULL_ID for null; vec: array of long, all of one length) as (vec_id, vec, cluster), and the final centroids.

    The start is the vectors with the smallest sha256 of ``seed:vec_id``; ties (repeated ids) go to the smaller vector, rows
    with a null id come last. Fewer vectors than ``clusters`` make fewer centroids; without vectors the result is empty.
    Repeated rows count each."""
    rank = F.when(F.col("vec_id") != NULL_ID, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    start = vectors.orderBy(rank.asc_nulls_last(), "vec").limit(clusters).collect()
    none = vectors.select("vec_id", "vec", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    if not start:
        return none.select("vec_id", "vec", "cluster"), np.zeros((0, 0), dtype=np.int64)
    centroids, before, state = np.array([r.vec for r in start], dtype=np.int64), None, none
    for k in range(rounds + 1):
        after = written(assigned(state, before, centroids), "assigned", keep=k == rounds)
        if k:
            discard(state)
        state = after
        if k < rounds:
            before, centroids = centroids, means(state, centroids)
    return state.select("vec_id", "vec", "cluster"), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector of ``embeddings``.

    Vectors of another length than DIMS, null ones and those with a null or non-finite component are left out. Rows
    with a null vec_id are clustered, but start no centroid while there are others; repeated rows each have their row. Distances are
    exact while they fit into 64 bits, that is for components under 2^27 after scaling."""
    vectors = table(spark, sf_dir, "embeddings").select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), whole_vector(F.col("embedding")).alias("vec")).where("vec is not null")
    with scratch(spark):
        state, centroids = clustered(written(vectors, "vectors"))
    texts = [",".join(map(str, c)) for c in centroids.tolist()]
    named = [(k, c, hashlib.sha256(t.encode()).hexdigest()) for k, (c, t) in enumerate(zip(centroids.tolist(), texts, strict=True))]
    ends = spark.createDataFrame(named, "cluster int, centroid array<long>, centroid_sha256 string")
    gaps = F.zip_with("vec", "centroid", lambda x, c: (x - c) * (x - c))
    found = state.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("distance"), "centroid_sha256")
    sums = [(r["cluster"], r["inertia"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()]  # a row for each cluster
    per = spark.createDataFrame([(k, s, sum(x for _, x in sums)) for k, s in sums], "cluster int, cluster_inertia long, inertia long")
    vec_id = F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id")
    return found.join(F.broadcast(per), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
