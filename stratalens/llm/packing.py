"""Packing documents into fixed-length sequences: cutting stock by column generation.

A document's ids are cut into pieces of the sequence length and one remainder. Short remainders are first put
together into bundles of about BUNDLE tokens, in a seeded order, so that what is planned is never short; then bundles
and other pieces are counted by length class (STEP tokens wide; a bundle or piece wastes less than a step, a hundredth
of it at most on average). A linear program over patterns (how many of each class share a sequence) covers the
histogram with the fewest sequences; patterns are priced into it by a knapsack dynamic program until the bound shows
that no pattern improves it by more than a thousandth. Solutions are rounded down, the few left over are packed
first-fit decreasing, and bundles and pieces, ranked within their class, take the patterns' places.

Only the histogram (at most length / STEP classes, whatever the input) reaches the driver, and the table of places
that goes back has a row for each class of each pattern. Ranks come from counts of seeded ranges a class, and bundles
are formed within ranges of 16 to 32 bundles, so no window holds a whole class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import tokens
from stratalens.llm.cut import cut, integer

LENGTH, STEP, RANGES = 4096, 16, 4096
SHORT, BUNDLE = 256, 1024  # a remainder that is bundled is shorter; tokens at which a bundle is full
PIECES = "_key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _order bigint"


def pieces(df: DataFrame, key: str, text: str, vocabulary: str, length: int = LENGTH, end: int = 2, seed: int = 1) -> DataFrame:
    """PIECES of each document: its ids and the end id, cut at multiples of length. _order is a seeded hash."""
    src = df.select(F.col(key).cast("bigint").alias("_key"), F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id()).alias("_order"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary)
        for b in batches:
            rows: list[tuple] = []
            for k, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = np.append(encode.ids(t.as_py()), np.uint32(end)).astype("<u4")
                # the order's low bits pick a range: pieces of one document go to different ones
                rows += [(k, at, len(part := ids[at : at + length]), zlib.crc32(part.tobytes()), len(ids), o ^ at // length) for at in range(0, len(ids), length)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return src.mapInArrow(cut_up, PIECES)


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: item i has size i + 1 and may repeat; sizes add up to at most capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = min(room, len(value))
        got = value[:n] + best[room - 1 :: -1][:n]
        i = int(np.argmax(got))
        best[room], choice[room] = (got[i], i) if got[i] > best[room - 1] else (best[room - 1], -1)
    pattern, room = np.zeros(len(value), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= choice[room] + 1
    return float(best[capacity]), pattern


def generate(demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each: minimise their number, covering demand by class.

    Revised simplex: the basis starts with one pattern of its own for each class asked for; each step prices one new
    pattern by knapsack() with the duals, until the bound sum(duals * demand) / best shows the gap is closed.
    """
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    basis = [np.eye(1, len(demand), i, dtype=np.int64)[0] * (capacity // (i + 1)) for i in rows]
    inverse = np.diag([1.0 / (capacity // (i + 1)) for i in rows])
    x = inverse @ demand[rows]
    for step in range(most):
        duals = inverse.sum(axis=0)
        value = np.zeros(len(demand))
        value[rows] = np.maximum(duals, 0)
        best, pattern = knapsack(value, capacity)
        if best <= 1 + 1e-9 or x.sum() * (1 - gap) <= value @ demand / best:
            break
        direction = inverse @ pattern[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-10, x / direction, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[out] = pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        x = np.maximum(inverse @ demand[rows], 0) if step % 50 == 49 else np.maximum(x - direction * ratio[out], 0)
        if step % 50 != 49:
            x[out] = ratio[out]
    return list(zip(basis, x, strict=True))


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that place every piece: the program's rounded down, then what is left over by
    first-fit decreasing. Patterns may have more places than there are pieces of a class."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, times in sorted(generate(demand, capacity), key=lambda p: -p[1]):
        n = int(times + 1e-6)
        if n:
            # the last of a class's places may stay empty; do not open more sequences than its pieces need
            need = max((-(-int(left[i]) // int(pattern[i])) for i in np.flatnonzero(pattern) if left[i] > 0), default=0)
            n = min(n, need)
            if n:
                out.append((pattern, n))
                left = np.maximum(left - pattern * n, 0)
    opened: list[list] = []  # [room, pattern]
    for i in range(len(left) - 1, -1, -1):
        for _ in range(int(left[i])):
            fit = next((b for b in opened if b[0] >= i + 1), None)
            if fit is None:
                fit = [capacity, np.zeros(len(demand), np.int64)]
                opened.append(fit)
            fit[0] -= i + 1
            fit[1][i] += 1
    return out + [(b[1], 1) for b in opened]


def bundles(known: DataFrame, length: int) -> DataFrame:
    """known with the unit that each piece belongs to: _unit (a number; a bundle's is negative) and _in (tokens before
    the piece in its unit). A bundle is closed by the piece that would make it larger than BUNDLE."""
    short, full = min(SHORT, length), min(BUNDLE, length)
    tokens = known.where(f"length < {short}").agg(F.sum("length")).first()[0] or 0
    ranges = 1 << max(0, (tokens // (16 * full)).bit_length() - 1)
    alone = known.where(f"length >= {short}").select("*", F.monotonically_increasing_id().alias("_unit"), F.lit(0).cast("bigint").alias("_in"))
    names = alone.columns
    few = known.where(f"length < {short}").withColumn("_range", F.col("_order").bitwiseAND(ranges - 1))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, size = -1, 0, 0
        for b in batches:
            units, before = [], []
            for r, n in zip(b.column("_range").to_pylist(), b.column("length").to_pylist(), strict=True):
                if r != now:
                    now, number, size = r, 0, 0
                elif size + n > full:
                    number, size = number + 1, 0
                units.append(-1 - (r << 24 | number))  # a range has some 16 to 32 bundles
                before.append(size)
                size += n
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(units, pa.int64()), pa.array(before, pa.int64())], names)

    together = few.repartition("_range").sortWithinPartitions("_range", "_order", "_key", "start").mapInArrow(fill, alone.schema)
    return alone.union(together)


def pack(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece.

    Null and empty texts are the end id alone. Rows that repeat are documents of their own, and so are rows without a
    key. A key must be an integer. Other columns are not read. An empty table gives no rows. Every id lies in one
    piece, pieces of a sequence follow each other from 0 without a gap, and no sequence is longer than length.
    sequence_id runs from 0.
    """
    spark = df.sparkSession
    integer(df, key)
    known = cut(pieces(df, key, text, vocabulary, length), "packing-pieces")
    units = cut(bundles(known, length), "packing-units")
    ranked = units.groupBy("_unit").agg(F.sum("length").alias("_size"), F.min("_order").alias("_order"))
    ranked = ranked.select("_unit", "_size", "_order", F.expr(f"CAST((_size + {step - 1}) div {step} AS int)").alias("_class"), F.col("_order").bitwiseAND(RANGES - 1).alias("_range"))
    capacity = length // step
    demand = np.zeros(capacity, np.int64)
    for r in ranked.groupBy("_class").count().collect():  # at most capacity rows
        demand[r["_class"] - 1] = r["count"]
    # places: class, first rank, end rank, first sequence, places of the class in the pattern, order in the sequence
    places, first, taken = [], 0, np.zeros(capacity, np.int64)
    for pattern, times in plan(demand, capacity):
        for i in np.flatnonzero(pattern):
            n = int(pattern[i])
            places.append((int(i) + 1, int(taken[i]), int(taken[i]) + n * times, first, n))
            taken[i] += n * times
        first += times
    table = spark.createDataFrame(places, "_class int, _low bigint, _high bigint, _first bigint, _places bigint")
    before = Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranked.groupBy("_class", "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_class", "_range").orderBy("_order", "_unit")
    rank = ranked.withColumn("_rank", F.row_number().over(within) - 1).join(ranges, ["_class", "_range"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # a class has at most as many rows here as there are patterns, whatever the number of documents
    placed = rank.join(F.broadcast(table), "_class").where("_rank >= _low AND _rank < _high").select("_unit", "_size", "_rank", F.expr("_first + (_rank - _low) div _places").alias("sequence_id"))
    along = Window.partitionBy("sequence_id").orderBy(F.desc("_size"), "_rank", "_in", "_key", "start").rowsBetween(Window.unboundedPreceding, -1)
    out = units.join(placed, "_unit")
    return out.select(F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).alias("offset"))
