"""Centroid clustering: Lloyd's rounds over integer vectors, exact to the last unit.

Components become integers (floor of `scale` times each) and vectors go in blocks of BLOCK rows. A block meets all
centroids in one matrix product: |x|^2 - 2 x.c + |c|^2 in float64 BLAS. Every partial sum of it is an integer of at
most d * (max|x| + max|c|)^2, so below 2^53 the product is exact in whatever order BLAS adds. The guard is 2^50, which
leaves room for the sums of a block; rows beyond it are computed with Python's integers, which have no bound. An RDD's
treeAggregate adds up counts, component sums and inertia of each cluster; the driver holds clusters x components
numbers, whatever the input. Nothing is shuffled by cluster, so a cluster, or a vector, with a third of all rows
costs no task more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.cut import cut, hidden

BLOCK, EXACT, LARGE, SLOW_ROWS = 1024, 2.0**50, 2.0**60, 32
#: Beyond this, a component's 256-fold leaves the range of double: such vectors go, as those that are not finite do.
LARGEST = 2.0**1000
Centroids = list[list[int]]


def kept(df: DataFrame, vector: str, components: int) -> DataFrame:
    """The rows whose vector has that many components, none of them null, NaN, infinite or beyond LARGEST."""
    return df.where((F.size(vector) == components) & F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & (x < LARGEST) & (x > -LARGEST)))


def blocks(rows: DataFrame, components: int, scale: int) -> DataFrame:
    """(keys, block) of rows (key, vector): BLOCK vectors' integers as float64, row after row."""
    key = rows.schema[0].dataType

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components) * float(scale))
            for at in range(0, len(b), BLOCK):
                keys = pa.ListArray.from_arrays(pa.array([0, len(b.column(0)[at : at + BLOCK])], pa.int32()), b.column(0)[at : at + BLOCK])
                yield pa.RecordBatch.from_arrays([keys, pa.array([x[at : at + BLOCK].tobytes()], pa.binary())], ["keys", "block"])

    return rows.mapInArrow(gather, T.StructType([T.StructField("keys", T.ArrayType(key)), T.StructField("block", T.BinaryType())]))


def _slowly(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """nearest() for rows of any size, in Python's integers."""
    c = np.array(centroids, object)
    best, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for at in range(0, len(x), SLOW_ROWS):
        part = np.array([[int(v) for v in row] for row in x[at : at + SLOW_ROWS]], object)
        far = ((part[:, None, :] - c[None]) ** 2).sum(axis=2)
        best[at : at + SLOW_ROWS] = [min(range(len(c)), key=row.__getitem__) for row in far]
        distance[at : at + SLOW_ROWS] = far.min(axis=1)
    return best, distance


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, distance, fast) of each row: the nearest centroid (of equals the least number), the exact squared
    distance, and whether it came from the product. Distances are int64 if all rows are fast."""
    top = max((abs(v) for c in centroids for v in c), default=0)
    size = np.abs(x).max(axis=1, initial=0)
    fast = (np.minimum(size, LARGE) + float(min(LARGE, top))) ** 2 * x.shape[1] < EXACT
    best, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if fast.any():
        y, c = (x if fast.all() else x[fast]), np.array(centroids, np.float64)
        far = np.einsum("ij,ij->i", y, y)[:, None] - 2 * (y @ c.T) + np.einsum("ij,ij->i", c, c)
        best[fast] = far.argmin(axis=1)
        distance[fast] = far.min(axis=1).astype(np.int64)
    if not fast.all():
        distance = distance.astype(object)
        best[~fast], distance[~fast] = _slowly(x[~fast], centroids)
    return best, distance, fast


Sums = dict[int, list]  # cluster: [count, inertia, component sums]


def _add(into: Sums, other: Sums) -> Sums:
    for k, (n, far, sums) in other.items():
        mine = into.setdefault(k, [0, 0, [0] * len(sums)])
        mine[0] += n
        mine[1] += far
        mine[2] = [a + b for a, b in zip(mine[2], sums, strict=True)]
    return into


def sums(x: np.ndarray, centroids: Centroids) -> Sums:
    """Counts, inertia and exact component sums of a block's rows by cluster."""
    best, distance, fast = nearest(x, centroids)
    found: Sums = {}
    if fast.any():
        own = np.eye(len(centroids))[best[fast]]
        total = own.T @ x[fast]
        for k in np.unique(best[fast]).tolist():
            at = fast & (best == k)
            found[k] = [int(at.sum()), sum(distance[at].tolist()), [int(v) for v in total[k]]]
    for i in np.flatnonzero(~fast).tolist():
        _add(found, {int(best[i]): [1, int(distance[i]), [int(v) for v in x[i]]]})
    return found


def _matrix(raw: bytes, components: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, components)


def totals(table: DataFrame, centroids: Centroids, components: int) -> Sums:
    """Sums over all blocks. What travels is one Sums a task, merged in a tree of executors."""
    return table.select("block").rdd.treeAggregate({}, lambda acc, row: _add(acc, sums(_matrix(bytes(row[0]), components), centroids)), _add)


def cluster(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2") -> tuple[DataFrame, Centroids, Sums]:
    """((key, cluster, distance) of each kept vector, the final centroids, each cluster's count, inertia and sums).

    First centroids are the vectors with the least lowercase hexadecimal SHA-256 of `seed:key`, of equal hashes those
    with the least components; with fewer vectors there are fewer clusters. Each of `rounds` rounds takes every vector
    to its nearest centroid and replaces those that have vectors by the floor of their exact mean. Vectors are then
    taken to their centroids once more. Vectors of another length, null, or with null or non-finite components give
    no row. A vector without a key counts as any other, but is no first centroid. Rows that repeat count each. A
    distance beyond 64 bits is null; sums and inertia have no bound. Other columns are not read. An empty table: no
    rows, no centroids.
    """
    plain, (key_, vector_) = hidden(df, key, vector)
    rows = kept(plain, vector_, components).select(F.col(key_), F.col(vector_).cast("array<double>").alias(vector_))
    table = cut(blocks(rows, components, scale), "cluster-blocks")
    hashed = rows.where(F.col(key_).isNotNull()).withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key_).cast("string")), 256))
    first = hashed.orderBy("_hash", vector_).limit(clusters).collect()
    centroids = [[int(np.floor(v * float(scale))) for v in r[vector_]] for r in first]
    if not centroids:
        return table.limit(0).select(F.element_at("keys", 1).alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), [], {}
    for _ in range(rounds):
        for k, (n, _far, total) in totals(table, centroids, components).items():
            centroids[k] = [v // n for v in total]
    kind = table.schema["keys"].dataType.elementType

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, raw in zip(b.column(0), b.column(1), strict=True):
                best, distance, _ = nearest(_matrix(raw.as_py(), components), centroids)
                far = [d if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(best, pa.int32()), pa.array(far, pa.int64())], [key, "cluster", "distance"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return table.mapInArrow(place, schema), centroids, totals(table, centroids, components)
