"""Centroid clustering of vectors: Lloyd's rounds on distinct quantised vectors, weighted by how often each occurs.

1. Vectors of the right length without nulls, NaN or infinities become whole numbers, floor(SCALE * x).
2. Equal quantised vectors are one row with their number. This count combines before its shuffle, so that any number of copies is one row a task.
3. A round assigns distinct vectors in Arrow batches and sums them, times their numbers, for each centroid; a task sends one row for each
   centroid and component, Spark adds these up, and the driver gets k * components sums (2560 here), whatever the input's size.
4. Assignments are joined back to the ids by the hash of the quantised vector. Ids of a vector with very many copies are a skewed side of a plain
   join, which adaptive execution splits.

All arithmetic is in whole numbers: products of vectors are taken in doubles only where each result is below 2**53, sums in tasks are 64-bit where
they fit and Python's otherwise, sums over tasks are decimals. So results don't depend on partitions.

Defined results: vectors that aren't kept have no row; repeated ids and rows are rows of their own; a null id stays null, and counts as the empty text
when the first centroids are drawn; equal hashes there go by the vector; with fewer kept vectors than centroids each kept vector is one; an empty table, or one without kept vectors, gives an
empty one; extra columns, whatever their names, are ignored. A component beyond 2**26 in size after scaling raises an error, since squared distances then
needn't fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import written

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: The greatest size of a component, and the one up to which distances are exact in doubles.
MOST, EXACT = 1 << 26, 1 << 22


def quantised(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """array<int> of floor(scale * x), null for vectors that aren't kept."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = (F.size(vector) == size) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    small = F.forall(whole, lambda v: F.abs(v) <= MOST)
    return F.when(good, F.when(small, F.transform(whole, lambda v: v.cast("int"))).otherwise(F.raise_error(F.lit(f"a component beyond {MOST} after scaling")).cast("array<int>")))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance, exactly."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = q.astype(np.float64), centroids.astype(np.float64)
        d = (c * c).sum(1) - 2 * (x @ c.T)
        at = d.argmin(1)
        return at, (d[np.arange(len(q)), at] + (x * x).sum(1)).astype(np.int64)
    best, at = np.full(len(q), np.iinfo(np.int64).max), np.zeros(len(q), np.int64)
    for k, c in enumerate(centroids):
        d = ((q - c) ** 2).sum(1)
        closer = d < best
        best[closer], at[closer] = d[closer], k
    return at, best


def assigned(distinct: DataFrame, centroids: list[list[int]], size: int) -> DataFrame:
    """_key, _n, cluster, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for b in batches:
            at, d = nearest(_rows(b["_q"], size), c)
            yield pa.RecordBatch.from_arrays([b["_key"], b["_n"], pa.array(at.astype(np.int32)), pa.array(d)], names=["_key", "_n", "cluster", "distance"])

    return distinct.select("_key", "_n", "_q").mapInArrow(run, "_key binary, _n long, cluster int, distance long")


def partial_sums(centroids: list[list[int]], size: int) -> Callable:
    """For each centroid with vectors: their weighted sum by component, and their number as component -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        sums = np.zeros((len(c), size + 1), object)
        for b in batches:
            q, n = _rows(b["_q"], size), b["_n"].to_numpy()
            at, _ = nearest(q, c)
            fits = int(np.abs(q).max(initial=1)) * int(n.sum(dtype=object)) < 1 << 62
            both = np.concatenate([q, np.ones((len(q), 1), np.int64)], 1)
            weighted = both * n[:, None] if fits else both.astype(object) * n.astype(object)[:, None]
            for k in np.unique(at):
                sums[k] += weighted[at == k].sum(0).astype(object)
        rows = [(k, j if j < size else -1, str(s)) for k in range(len(c)) if sums[k, size] for j, s in enumerate(sums[k])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)], names=["cluster", "at", "total"])

    return run


def moved(distinct: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """Each centroid as the floor of its vectors' mean; those without vectors stay."""
    sums = distinct.select("_q", "_n").mapInArrow(partial_sums(centroids, size), "cluster int, at int, total string")
    got = {(r[0], r[1]): int(r[2]) for r in sums.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect()}
    return [[got[k, j] // got[k, -1] for j in range(size)] if (k, -1) in got else c for k, c in enumerate(centroids)]


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row for each kept vector: its id as id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, and copies, the number of vectors that are equal to it."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).alias("_id"), quantised(F.col(vector_col), size, scale).alias("_q")).filter("_q IS NOT NULL")
    keyed = kept.withColumn("_key", F.unhex(F.sha2(F.array_join("_q", ","), 256)))
    distinct = written(keyed.groupBy("_key", "_q").agg(F.count("*").alias("_n")), "distinct")

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r[0]) for r in kept.select("_q", draw.alias("_draw")).orderBy("_draw", "_q").limit(k).select("_q").collect()]
    for _ in range(rounds if centroids else 0):
        centroids = moved(distinct, centroids, size)

    last = written(assigned(distinct, centroids or [[0] * size], size), "assigned")
    by = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("_n")).alias("d")).collect()
    whole = sum(int(r.d) for r in by)
    told = [(r.cluster, int(r.d), whole, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in by]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = keyed.select("_id", "_key").join(last.withColumnRenamed("_n", "copies"), "_key").join(F.broadcast(about), "cluster")  # a row for each of at most k clusters
    return back.select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "copies")
