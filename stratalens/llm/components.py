"""Connected components of an edge table: alternating large-star and small-star rounds.

Every round is two joins on node ids and is written to the shared folder; only counts and a checksum reach the driver.
Minima are pre-aggregated before each shuffle, and a hub's neighbours sit on the side of an inner join that Spark may
split, so a node with a third of all edges holds up no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.cut import cut, discard


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another: component is the smallest node reachable.

    Edges are undirected; loops, repeats and edges with a null end count for nothing. An empty table gives no rows.
    Raises if most_rounds do not suffice (rounds grow with the logarithm of the longest path).
    """
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, before = cut(links, "components"), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u, and u itself by way of its own neighbours, goes to the least one around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: all smaller neighbours of u, and u, go to the least of them
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low)
        following = cut(small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components")
        discard(now)
        now, before = following, mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # now a star for each component: its least node u, and an edge to every other node v
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct())
