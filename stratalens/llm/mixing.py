"""Mixing overlapping sources to target weights by min-cost flow.

Documents belong to a set of sources, their membership pattern. Documents are aggregated by pattern; a flow network
routes each pattern's token capacity to the sources' quotas, where the n-th repetition of a token costs more than the
one before (convex costs), so that repetition is used only where first uses are exhausted. Documents then take their
part of their pattern's flow in a seeded order.

Only the table of patterns reaches the driver; its rows are bounded by max_patterns, beyond which the operator
raises. Nothing that grows with the number of documents is collected, and no window holds a whole source: the seeded
order is cut into 4096 ranges a pattern, ranges are added up first, and documents are ranked within one range.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import kernels
from stratalens.llm.cut import cut

RANGES = 4096


def sizes(df: DataFrame, text: str = "text", out: str = "size", keep: Sequence[str] = ()) -> DataFrame:
    """The columns keep and the number of words of each text (null: 0)."""
    src = df.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = df.select(*keep).withColumn(out, F.lit(0).cast("bigint")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kernels.word_counts(b.column(len(keep))), pa.int64())], [*keep, out])

    return src.mapInArrow(count, schema)


def quotas(size: dict, weight: Sequence[float], share: float, cap: float) -> dict:
    """Targets of sources in code-point order (null last): share of all sizes by repeating weights, each at most cap
    times its source's size, the excess reshared by weight until none is above."""
    order = sorted((k for k in size if k is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in size)
    w = {s: weight[i % len(weight)] for i, s in enumerate(order)}
    target, free, left = {}, list(order), share * sum(size.values())
    while free:
        unit = left / sum(w[s] for s in free)
        full = [s for s in free if w[s] * unit > cap * size[s]]
        if not full:
            target |= {s: w[s] * unit for s in free}
            break
        target |= {s: float(cap * size[s]) for s in full}
        left = max(0.0, left - sum(target[s] for s in full))
        free = [s for s in free if s not in target]
    return target


def flow(patterns: list[tuple[tuple, int]], target: dict, cap: float) -> list[dict]:
    """Tokens of each pattern that go to each source: a min-cost maximum flow.

    patterns: (sources, tokens). Arcs: start to pattern, once for each repetition r up to cap, with the tokens as its capacity and r as its cost;
    pattern to each of its sources, without cost; source to end with capacity round(target). A path's cost is that
    of its first arc, so successive shortest paths run through the cost levels in order, and each level is a maximum
    flow on the residual network (breadth-first augmentation).
    """
    room = {s: round(t) for s, t in target.items()}
    sent: list[dict] = [dict.fromkeys(p, 0) for p, _ in patterns]
    members: dict = {}
    for i, (p, _) in enumerate(patterns):
        for s in p:
            members.setdefault(s, []).append(i)
    for level in range(-(-int(cap * 1000) // 1000)):
        supply = [int(n * min(1, cap - level)) for _, n in patterns]
        for i in range(len(patterns)):
            while supply[i] > 0:
                # shortest augmenting path: pattern -> source -> (pattern that may give way) -> source ...
                came, queue, end = {("p", i): None}, deque([("p", i)]), None
                while queue and end is None:
                    kind, x = node = queue.popleft()
                    if kind == "p":
                        for s in patterns[x][0]:
                            if ("s", s) not in came:
                                came[("s", s)] = node
                                if room[s] > 0:
                                    end = ("s", s)
                                    break
                                queue.append(("s", s))
                    else:
                        for j in members[x]:
                            if sent[j][x] > 0 and ("p", j) not in came:
                                came[("p", j)] = node
                                queue.append(("p", j))
                if end is None:
                    break
                path, node = [end], end
                while came[node] is not None:
                    node = came[node]
                    path.append(node)
                path.reverse()
                amount = min(supply[i], room[end[1]], *(sent[path[k + 1][1]][path[k][1]] for k in range(1, len(path) - 1, 2)))
                for k in range(0, len(path) - 1, 2):
                    sent[path[k][1]][path[k + 1][1]] += amount
                for k in range(1, len(path) - 1, 2):
                    sent[path[k + 1][1]][path[k][1]] -= amount
                supply[i] -= amount
                room[end[1]] -= amount
    return sent


def mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2, seed: int = 20_25, max_patterns: int = 100_000) -> DataFrame:
    """Words that each document gives to the mix: key, size, source_size, target, taken.

    source is a string (one source) or an array of strings (overlapping sources; then source_size and target are
    those of the pattern: the sum over its sources of what they are). Texts that are null or empty have size 0 and
    give 0. Rows that repeat are documents of their own. An empty table gives an empty result. Clashing names in df
    do no harm: only the three columns named are read.
    Sources whose weights' share exceeds cap times their size keep that size times cap; no document gives more than
    cap times its size. The order of documents depends on seed and key, and of rows
    that share a key on size and text, so reruns agree.
    """
    spark = df.sparkSession
    many = dict(df.dtypes)[source].startswith("array")
    raw = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    # rows may share a key: their texts then settle the order
    sized = sizes(raw.withColumn("_tie", F.xxhash64("_text")), "_text", "size", ["_key", "_source", "_tie"])
    pattern = F.array_sort(F.array_distinct(F.coalesce("_source", F.array().cast("array<string>")))) if many else F.array("_source")
    order = F.xxhash64(F.lit(seed), F.col("_key"))
    docs = cut(sized.select("_key", "_tie", "size", pattern.alias("_pattern"), order.alias("_order")), "mix-sizes")
    rows = docs.groupBy("_pattern").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted(((tuple(r["_pattern"]), r["n"]) for r in rows), key=lambda x: [(s is None, s or "") for s in x[0]])
    size: dict = {}
    for p, n in patterns:
        for s in p:
            size[s] = size.get(s, 0) + n
    target = quotas(size, weights, share, cap) if size else {}
    sent = flow(patterns, target, cap)
    plan = spark.createDataFrame(
        [(list(p), sum(size[s] for s in p), float(sum(target[s] for s in p)), n, sum(f.values())) for (p, n), f in zip(patterns, sent, strict=True)],
        "_pattern array<string>, source_size bigint, target double, _n bigint, _flow bigint",
    )
    rank = F.col("_order").bitwiseAND(RANGES - 1)
    ranked = docs.withColumn("_range", rank)
    before = Window.partitionBy("_pattern").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranked.groupBy("_pattern", "_range").agg(F.sum("size").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    # plan has a row for each pattern and ranges 4096 of them: small, but joined by whatever way Spark finds its size fits
    ranges = ranges.join(plan, ranges["_pattern"].eqNullSafe(plan["_pattern"])).select(ranges["_pattern"], "_range", "_before", "source_size", "target", "_n", "_flow")
    within = Window.partitionBy("_pattern", "_range").orderBy("_order", "_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("a").join(ranges.alias("b"), F.col("a._pattern").eqNullSafe(F.col("b._pattern")) & (F.col("a._range") == F.col("b._range")))
    whole = F.expr("CASE WHEN _n > 0 THEN _flow div _n ELSE 0L END")
    rest = F.col("_flow") - whole * F.col("_n") - F.col("_before") - F.col("_within")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(F.col("_key").alias(key), "size", "source_size", "target", taken.cast("bigint").alias("taken"))
