"""Spherical k-means over all vectors, and search of the nearest partitions of an inverted file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.search import _unit


def kmeans(rows: DataFrame, vector: str = "vector", k: int = 64, iterations: int = 20, dims: int = 64, tolerance: float = 1e-6, seed: int = 42) -> np.ndarray:
    """At most k unit centroids: those of the largest cosine sums, from k vectors that a seeded hash picks.

    Every iteration passes over all rows and adds up one row per centroid and task; the
    driver holds centroids only. Empty clusters keep their centroid. Unusable vectors
    don't take part; without any there are no centroids.
    """
    usable = rows.filter(F.size(vector) == dims).select(vector)
    first = usable.select(vector, F.xxhash64(vector, F.lit(seed)).alias("_h")).distinct().orderBy("_h").limit(k).select(vector).toArrow()
    start = [_unit(c, dims)[1] for c in first.column(vector).chunks]
    centers = np.concatenate(start) if start else np.empty((0, dims))
    for _ in range(iterations if len(centers) else 0):

        def sums(batches: Iterator[pa.RecordBatch], centers=centers) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(centers)
            for b in batches:
                _, x = _unit(b.column(0), dims)
                if len(x):
                    np.add.at(total, (x @ centers.T).argmax(axis=1), x)
            at = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[i].tolist() for i in at], pa.list_(pa.float64()))], names=["c", "v"])

        parts = usable.mapInArrow(sums, "c bigint, v array<double>").select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).collect()
        moved = centers.copy()
        for c in {r["c"] for r in parts}:
            moved[c] = 0
        for r in parts:
            moved[r["c"], r["i"]] = r["x"]
        n = np.linalg.norm(moved, axis=1, keepdims=True)
        moved = np.divide(moved, n, out=centers.copy(), where=n > 0)
        if np.allclose(moved, centers, atol=tolerance):
            break
        centers = moved
    return centers


def assign(rows: DataFrame, centers: np.ndarray, probes: int, key: str, vector: str, dims: int = 64) -> DataFrame:
    """(key, part, unit) with the `probes` nearest centroids of every usable vector; a narrow map."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _unit(b.column(1), dims)
            near = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :probes] if len(at) else np.empty((0, probes), int)
            keys = b.column(0).take(pa.array(np.repeat(at, near.shape[1])))
            yield pa.RecordBatch.from_arrays([keys, pa.array(near.ravel().astype(np.int32)), pa.array([x[i].tolist() for i in np.repeat(np.arange(len(at)), near.shape[1])], pa.list_(pa.float64()))], names=[key, "part", "unit"])

    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kind}, part int, unit array<double>")


def ivf_search(queries: DataFrame, rows: DataFrame, centers: np.ndarray, k: int = 10, probes: int = 4, dims: int = 64) -> DataFrame:
    """(query_id, id, similarity): the k most similar rows among those of the partitions nearest to a query. `queries` has query_id and vector, `rows` id and vector.

    Partitions are joined by their number; a skewed one is split by the adaptive plan.
    A query isn't its own answer; ties go to the smaller id.
    """
    q = assign(queries, centers, probes, "query_id", "vector", dims).withColumnRenamed("unit", "q")
    d = assign(rows, centers, 1, "id", "vector", dims)
    sim = F.aggregate(F.zip_with("q", "unit", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    s = q.join(d, "part").filter("query_id <> id").select("query_id", "id", F.round(sim, 9).alias("similarity"))
    return s.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).filter(F.col("_n") <= k).drop("_n")
