"""Vector index with exact pruning: top-k by cosine similarity without comparing every pair.

Vectors go to the cell of their nearest coarse centroid. Centroids are fitted on a bounded sample (SAMPLE_A_CELL rows a
cell, the least by a hash of the key), every vector is placed. Within a cell, vectors are sorted by their angle to the
centroid and packed in blocks, each with the least and greatest angle in it. Angles on the sphere obey the triangle
inequality, so a vector at angle a from the centroid is at least |b - a| from a query at angle b.

A search first asks each query's nearest cells that hold k vectors; the k-th best similarity there is a floor. Then a query
meets only the blocks whose angles the floor lets through, wherever they are. So the result is that of a full scan, to
the order of ties, and what is left out is proven to lie below. On vectors without clusters in many dimensions few blocks can be
ruled out: the search then costs what a scan does.

The index is a table partitioned by cell, with blocks' bounds beside it; queries may be as many as they like, they are
rows. The driver holds the centroids and the sample.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, GROUP, SAMPLE_A_CELL, ROUNDS, MOST_CELLS = 256, 64, 64, 8, 4096
#: What rounding may do to an angle: added to every bound, never taken from it.
SLACK = 1e-7


@dataclass
class Index:
    """blocks: (cell, block, keys, labels, unit vectors, n, low, high); centroids; of each cell its rows and bounds."""

    blocks: DataFrame
    centroids: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def rows(self) -> int:
        return int(self.counts.sum())


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _usable(df: DataFrame, embedding: str, size: int) -> DataFrame:
    """Rows whose vector has `size` components, all finite, not all zero."""
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & (F.abs(x) < 1e150) & ~F.isnan(x))
    return df.where((F.size(embedding) == size) & finite & F.exists(F.col(embedding), lambda x: F.abs(x) > 1e-150))


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means on the sample; first centroids far from each other."""
    unit = _unit(sample)
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(cells, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    centroids = unit[chosen]
    for _ in range(ROUNDS):
        own = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        moved = np.sqrt((sums * sums).sum(axis=1)) > 1e-9
        centroids[moved] = _unit(sums[moved])
    return centroids


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def build(df: DataFrame, path: str, *, key: str = "vec_id", embedding: str = "embedding", label: str | None = None, size: int = 64, cells: int | None = None) -> Index:
    """The index of df's vectors, written below path as a table partitioned by cell.

    Vectors that are null, of another length, not finite or all zero are not indexed, as they have no similarity. Keys
    are integers; labels (of any column) may be asked for in a search. cells: the square root of the rows, if not given.
    """
    spark = df.sparkSession
    kept = df.select(F.col(key).cast("bigint").alias("key"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    rows = _usable(kept, "v", size)
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(cells * SAMPLE_A_CELL).select("v").toPandas()["v"]
    centroids = _fit(np.array(sample.tolist()), cells) if n else np.zeros((0, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_matrix(b.column(2), size))
            near = unit @ centroids.T
            cell = near.argmax(axis=1)
            angle = _angle(near[np.arange(len(cell)), cell])
            vectors = pa.array([row.tobytes() for row in unit], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vectors, pa.array(cell, pa.int32()), pa.array(angle)], ["key", "label", "v", "cell", "angle"])

    placed = rows.mapInArrow(place, "key bigint, label string, v binary, cell int, angle double")
    kind = "cell int, block string, keys array<bigint>, labels array<string>, vectors binary, n bigint, low double, high double"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # sorted by cell and angle
            cell = b.column(3).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            out = []
            for start, end in zip(starts, starts[1:], strict=False):
                for at in range(start, end, BLOCK):
                    part = b.slice(at, min(BLOCK, end - at))
                    angle = part.column(4).to_numpy()
                    out.append({"cell": int(cell[at]), "block": uuid.uuid4().hex, "keys": part.column(0).to_pylist(), "labels": part.column(1).to_pylist(), "vectors": b"".join(part.column(2).to_pylist()), "n": len(part), "low": float(angle.min()), "high": float(angle.max())})
            yield from pa.Table.from_pylist(out, _BLOCKS).to_batches()

    # large cells are split, small ones share a task
    packed = placed.hint("rebalance", "cell").sortWithinPartitions("cell", "angle").mapInArrow(pack, kind)
    packed.write.mode("errorifexists").partitionBy("cell").parquet(path)
    blocks = spark.read.schema(kind).parquet(path)
    counts, low, high = np.zeros(len(centroids), np.int64), np.full(len(centroids), 9.0), np.full(len(centroids), -9.0)
    for r in blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        counts[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    return Index(blocks, centroids, counts, low, high)


_BLOCKS = pa.schema([("cell", pa.int32()), ("block", pa.string()), ("keys", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def _cells(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, label, v, cell, angle, reach) of queries (query, label, v, reach): the cells that may hold vectors
    within the angle `reach`; without one the nearest cells that together hold k vectors. v comes out as bytes."""
    centroids, counts, low, high = index.centroids, index.counts, index.low, index.high

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_matrix(b.column(2), centroids.shape[1]))
            angles = _angle(unit @ centroids.T)
            reach = b.column(3).to_numpy(zero_copy_only=False).astype(float)
            order = np.argsort(angles, axis=1, kind="stable")
            within = np.cumsum(counts[order], axis=1) - counts[order] < k
            probe = np.zeros_like(within)
            np.put_along_axis(probe, order, within, axis=1)
            near = (angles - reach[:, None] <= high) & (angles + reach[:, None] >= low)
            row, cell = np.nonzero(np.where(np.isnan(reach)[:, None], probe & (counts > 0), near))
            vectors = pa.array([x.tobytes() for x in unit], pa.binary())
            columns = [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), vectors.take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(angles[row, cell]), pa.array(reach[row])]
            yield pa.RecordBatch.from_arrays(columns, ["query", "label", "v", "cell", "angle", "reach"])

    return asked.select("query", "label", "v", "reach").mapInArrow(choose, "query bigint, label string, v binary, cell int, angle double, reach double")


def _compare(pairs: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, key, similarity): of pairs (cell, block, query, label, v) the k most similar of each block."""
    size = index.centroids.shape[1]
    # queries of a block go in groups, so that a block is sent once for each GROUP of them
    slot = F.pmod(F.xxhash64("query"), F.expr(f"_n div {GROUP} + 1"))
    wide = pairs.join(pairs.groupBy("block").agg(F.count("*").alias("_n")), "block")
    groups = wide.groupBy("cell", "block", slot.alias("slot")).agg(F.collect_list(F.struct("query", "label", "v")).alias("asked"))
    rows = index.blocks.select("cell", "block", "keys", "labels", "vectors").join(groups, ["cell", "block"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            for r in b.to_pylist():
                x, keys = np.frombuffer(r["vectors"]).reshape(-1, size), np.array(r["keys"], np.int64)
                for q in r["asked"]:
                    near = (x * np.frombuffer(q["v"])).sum(axis=1)  # the same sum for equal vectors, wherever they stand
                    allowed = np.flatnonzero([label == q["label"] for label in r["labels"]]) if q["label"] is not None else np.arange(len(keys))
                    best = allowed[np.lexsort((keys[allowed], -near[allowed]))[:k]]
                    found += [(q["query"], int(keys[i]), float(near[i])) for i in best]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "key", "similarity"])

    return rows.select("keys", "labels", "vectors", "asked").mapInArrow(compare, "query bigint, key bigint, similarity double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def candidates(index: Index, queries: DataFrame, k: int, *, key: str = "vec_id", embedding: str = "embedding", label: str | None = None) -> DataFrame:
    """(cell, block, n, query, label, v): the blocks that each query must meet."""
    size = index.centroids.shape[1]
    given = queries.select(F.col(key).cast("bigint").alias("query"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    asked = _usable(given, "v", size)
    bounds = index.blocks.select("cell", "block", "n", "low", "high")
    probed = _cells(asked.withColumn("reach", F.lit(None).cast("double")), index, k).join(bounds.select("cell", "block"), "cell")
    best = _ranked(_compare(probed, index, k), k).groupBy("query").agg(F.count("*").alias("_found"), F.min("similarity").alias("_least"))
    floor = F.when(F.col("_found") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_least"))))).otherwise(4.0) + SLACK
    reaching = asked.join(best, "query", "left").withColumn("reach", F.coalesce(floor, F.lit(4.0)))
    near = _cells(reaching, index, k).join(bounds, "cell")
    return near.where((F.col("angle") - F.col("reach") <= F.col("high")) & (F.col("angle") + F.col("reach") >= F.col("low"))).select("cell", "block", "n", "query", "label", "v")


def search(index: Index, queries: DataFrame, k: int = 10, *, key: str = "vec_id", embedding: str = "embedding", label: str | None = None) -> DataFrame:
    """(query, key, similarity, rank): the k most similar vectors of each query, of equals the least key; with a label
    only vectors of that label (null: any). Fewer than k vectors give fewer rows; a query without similarity none.
    Queries' keys tell them apart."""
    pairs = candidates(index, queries, k, key=key, embedding=embedding, label=label).drop("n")
    return _ranked(_compare(pairs, index, k), k)


def share_compared(index: Index, pairs: DataFrame, queries: int) -> float:
    """The share of all pairs of a query and a vector that candidates() leaves."""
    met = pairs.agg(F.sum("n")).first()[0] or 0
    return met / max(1, queries * index.rows)
