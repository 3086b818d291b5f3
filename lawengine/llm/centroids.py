"""Centroid clustering with partial-distance search.

Vectors are turned into integers, so that sums, centroids and distances are exact whatever the order of addition. To find
the nearest centroid, squared differences are added up a few dimensions at a time, those of the highest variance first; a
centroid is abandoned once its partial sum is strictly above the best whole distance known for the row, and what survives
has its whole distance. Ties are for the smaller number, so the result is that of a full search.

In a round each task assigns its rows and hands on one sum and count for each centroid; Spark adds these up and the driver takes
`clusters` rows. Nothing else leaves the tasks.

Only vectors of exactly `dim` components, none null or non-finite, take part. An integer beyond 2^27 in size counts as 2^27, as
the long distance couldn't hold more. A null vec_id takes part, but comes last among the starts. Repeated rows count each; rows of one
vec_id are ordered by their components where starts are chosen. With fewer vectors than clusters, each is a start; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, only_columns, written

#: Dimensions that are added at a time, rows that are searched at a time, and the largest size of a component.
STEP, ROWS, LARGEST = 8, 4096, 1 << 27


def nearest(rows: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid and the squared distance; order: the dimensions, those to be added first first."""
    rows, centroids = rows[:, order], centroids[:, order]
    head = ((rows[:, None, :step] - centroids[None, :, :step]) ** 2).sum(2)
    likely = head.argmin(1)
    best = ((rows - centroids[likely]) ** 2).sum(1)
    row, number = np.nonzero(head <= best[:, None])
    part = head[row, number]
    for at in range(step, rows.shape[1], step):
        part = part + ((rows[row, at : at + step] - centroids[number, at : at + step]) ** 2).sum(1)
        alive = part <= best[row]
        row, number, part = row[alive], number[alive], part[alive]
    first = np.lexsort((number, part, row))
    first = first[np.r_[True, np.diff(row[first]) > 0]] if len(row) else first
    return number[first].astype(np.int32), part[first]


def integers(rows: DataFrame, *, id_column: str, vector_column: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v (dim 32-bit integers as bytes) of the vectors that take part."""
    rows = only_columns(rows, id_column, vector_column).toDF("vec_id", "vector").withColumn("vec_id", F.col("vec_id").cast("long"))
    whole = (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def run(it):
        for b in it:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            whole = np.clip(np.floor(v * scale), -LARGEST, LARGEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in whole], pa.binary())], ["vec_id", "v"])

    return rows.filter(whole).mapInArrow(run, "vec_id long, v binary")


def _arrays(batches, dim: int):
    """(batch, its integers), a bounded number of rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, np.frombuffer(b"".join(part.column("v").to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _totals(stored: DataFrame, run) -> list:
    """Sums that tasks hand on as rows (cluster, place, amount), added up; as many rows as there are clusters and places."""
    exact = F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")
    return stored.mapInArrow(run, "cluster int, place int, amount long").groupBy("cluster", "place").agg(exact).collect()


def _rows(sums: np.ndarray) -> pa.RecordBatch:
    k, n = sums.shape
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), k)), pa.array(sums.ravel().astype(np.int64))], ["cluster", "place", "amount"])


def by_variance(stored: DataFrame, dim: int) -> np.ndarray:
    """The dimensions, those of the highest variance first; the order is for speed alone."""

    def run(it):
        sums = np.zeros((2, dim + 1))
        for _, v in _arrays(it, dim):
            sums[:, :dim] += v.sum(0), (v.astype(float) ** 2).sum(0)
            sums[:, dim] += len(v)
        yield _rows(np.minimum(sums, 2.0**62))

    m = np.zeros((2, dim + 1))
    for r in _totals(stored, run):
        m[r["cluster"], r["place"]] = float(r["amount"])
    n = max(m[0, dim], 1.0)
    return np.argsort(-(m[1, :dim] / n - (m[0, :dim] / n) ** 2), kind="stable")


def clustered(rows: DataFrame, *, clusters: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array) and centroid_sha256 of every vector that takes part."""
    spark = rows.sparkSession
    stored = written(integers(rows, id_column=id_column, vector_column=vector_column, dim=dim, scale=scale), "integer-vectors")
    starts = stored.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)), "v").limit(clusters).collect()
    centroids = np.array([np.frombuffer(r["v"], "<i4") for r in starts], dtype=np.int64).reshape(-1, dim)
    if not len(centroids):
        discard(stored)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    order = by_variance(stored, dim)
    for _ in range(rounds):

        def run(it, centroids=centroids):
            sums = np.zeros((len(centroids), dim + 1), dtype=np.int64)
            for _, v in _arrays(it, dim):
                number, _ = nearest(v, centroids, order)
                for k in np.unique(number):
                    own = v[number == k]
                    sums[k, :dim] += own.sum(0)
                    sums[k, dim] += len(own)
            yield _rows(sums)

        found: dict = {}
        for r in _totals(stored, run):
            found[r["cluster"], r["place"]] = int(r["amount"])
        centroids = np.array([[found[k, d] // found[k, dim] for d in range(dim)] if found.get((k, dim)) else c for k, c in enumerate(centroids.tolist())], dtype=np.int64)

    def assign(it):
        for b, v in _arrays(it, dim):
            number, distance = nearest(v, centroids, order)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    met = written(stored.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    discard(stored)
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")
    own = {r["cluster"]: min(int(r["s"]), (1 << 63) - 1) for r in met.groupBy("cluster").agg(exact).collect()}  # a row for each cluster
    total = min(sum(own.values()), (1 << 63) - 1)
    told = [(k, own[k], total, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist()) if k in own]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return met.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
