"""Knowledge graphs as two DataFrames: nodes (id, labels, properties) and edges (source, target, type, ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import vocab
from stratalens.sources.tables import shared

RELATION_OF = {"regions": "OPERATES_IN_REGION", "countries": "OPERATES_IN", "operations": "HAS_OPERATION", "risk_types": "HAS_RISK_TYPE"}


def triples(entities: DataFrame, companies: DataFrame) -> DataFrame:
    """(subject, relation, object), distinct: sector and industry of companies, and their entities."""
    known = F.array(F.struct(F.lit("HAS_SECTOR").alias("relation"), F.col("sector").alias("object")), F.struct(F.lit("HAS_INDUSTRY").alias("relation"), F.col("industry").alias("object")))
    own = companies.select(F.col("ticker").alias("subject"), F.explode(known).alias("r")).select("subject", "r.*").where("object IS NOT NULL AND object != ''")
    kind = F.create_map(*[F.lit(x) for pair in RELATION_OF.items() for x in pair])
    return own.unionByName(entities.select(F.col("ticker").alias("subject"), F.try_element_at(kind, F.col("category")).alias("relation"), F.col("value").alias("object")).where("relation IS NOT NULL")).distinct()


def dedupe(triples_: DataFrame, order: str) -> DataFrame:
    """Distinct triples with the place of the first."""
    return triples_.groupBy("subject", "relation", "object").agg(F.min(order).alias(order))


def pattern_edges(sections: DataFrame, most: int = 3) -> DataFrame:
    """(source, target, type, confidence): at most so many hits of each pattern a section, longer than two letters."""

    def hits_of(pattern: str, relation: str) -> Column:
        found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1))
        return F.transform(F.slice(found, 1, most), lambda t: F.struct(F.lit(relation).alias("type"), t.alias("target")))

    hits = [hits_of(p, relation) for p, relation in vocab.RELATIONS]
    return sections.select(F.col("ticker").alias("source"), F.explode(F.concat(*hits)).alias("h")).select("source", "h.target", "h.type", F.lit(0.6).alias("confidence")).where(F.length("target") > 2).distinct()


def evidence(entities: DataFrame, sections: DataFrame, most: int = 5) -> DataFrame:
    """(ticker, value, evidence): titles of the company's first sections that name the value. Joined by company, so
    an entity meets only sections of its own."""
    s = sections.select("ticker", "pos", "title", F.lower("text").alias("_low"))
    hit = entities.select("ticker", "value").distinct().join(s, "ticker").where(F.col("_low").contains(F.lower("value")))
    # a rank limit, which Spark applies before the shuffle: no list of all titles is held
    rank = F.row_number().over(Window.partitionBy("ticker", "value").orderBy("pos", "title"))
    first = hit.select("ticker", "value", "pos", "title").withColumn("_rank", rank).where(F.col("_rank") <= most)
    return first.groupBy("ticker", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "title"))), lambda x: x.title).alias("evidence"))


def graph(companies: DataFrame, entities: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Company, Country (0.8) and Operation (0.7) nodes and edges, and pattern edges (0.6)."""
    proof = evidence(entities, sections)
    e = entities.where(F.col("category").isin("countries", "operations")).join(proof, ["ticker", "value"], "left")
    country = F.col("category") == "countries"
    edges = e.select(F.col("ticker").alias("source"), F.col("value").alias("target"), F.when(country, "OPERATES_IN").otherwise("HAS_OPERATION").alias("type"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.when(country, 0.8).otherwise(0.7).alias("confidence"))
    found = pattern_edges(sections)
    edges = edges.unionByName(found.select("source", "target", "type", F.array().cast("array<string>").alias("evidence"), "confidence"))
    nodes = companies.select(F.col("ticker").alias("id"), F.lit("Company").alias("label"), F.create_map(F.lit("name"), F.coalesce("company", "ticker")).alias("properties"))
    nodes = nodes.unionByName(e.select(F.col("value").alias("id"), F.when(country, "Country").otherwise("Operation").alias("label"), F.create_map(F.lit("name"), F.col("value")).alias("properties"))).unionByName(found.select(F.col("target").alias("id"), F.lit("Country").alias("label"), F.create_map(F.lit("name"), F.col("target")).alias("properties")))
    order = F.when(F.col("label") == "Company", 0).when(F.col("label") == "Country", 1).otherwise(2)
    return merge_nodes(nodes.withColumn("ord", order), "ord"), edges


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """(id, labels, properties) of nodes (id, label, properties, order): the label is that of the first, properties are
    merged and a later value wins (of equal places the greater one)."""
    first = nodes.groupBy("id").agg(F.array(F.min_by("label", F.struct(order, "label"))).alias("labels"))
    each = nodes.select("id", order, F.explode_outer("properties").alias("key", "value")).where("key IS NOT NULL")
    last = each.groupBy("id", "key").agg(F.max_by("value", F.struct(order, "value")).alias("value"))
    merged = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    return first.join(merged, "id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def created(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(type, created): how many relations of each type have both ends."""
    return linked(edges, nodes).groupBy("type").agg(F.count("*").alias("created"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """MERGE: rows by key; new values win where they are not null."""
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in key])
    columns = [F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in n.columns else F.col(c) for c in old.columns if c not in key]
    return old.join(n, key, "full").select(*key, *columns)


def linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids.withColumnRenamed("id", "_t"), F.col("target") == F.col("_t"), "left_semi")


def kept_relation(kind: Column) -> Column:
    """The node label a relation leads to: suppliers, or sectors for countries and operations; null drops it."""
    up = F.upper(kind)
    return F.when(up.contains("SUPPLI"), "Supplier").when(up.contains("COUNTRY") | up.contains("OPERATES"), "Sector")


def companies_in_sector(edges: DataFrame, sector: str) -> DataFrame:
    return edges.where((F.col("type") == "OPERATES_IN") & (F.col("target") == sector)).select(F.col("source").alias("ticker")).distinct()


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): nodes within depth undirected steps of start.id, by least hops. One join a step, from the
    nodes of the step before only; a node that is met again has more hops and falls away in the one aggregation. More
    than two steps go by expand()."""
    if depth > 2:
        return expand(edges, start, depth).drop("hub")
    both = edges.select(F.col("source").alias("_a"), F.col("target").alias("_b")).union(edges.select("target", "source")).distinct()
    front = start.select(F.col("id").alias("start"), F.col("id").alias("node"))
    found = front.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        front = front.join(both, F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node")).distinct()
        found = found.unionByName(front.withColumn("hops", F.lit(hop)))
    return found.groupBy("start", "node").agg(F.min("hops").alias("hops")).where("hops > 0")


def expand(edges: DataFrame, start: DataFrame, depth: int, most_degree: int | None = None) -> DataFrame:
    """(start, node, hops, hub): nodes within depth undirected steps of start.id, for any depth, by least hops.

    Semi-naive: each hop goes on from the nodes that the hop before was the first to meet, and keeps what no earlier hop
    has met; it is written to the shared folder, so plans stay short and a lost executor costs one hop. The search
    ends when a hop meets nothing new. A node with more than most_degree neighbours is a hub: it is met, and said to be
    one, but not passed through, unless it is the start; without most_degree there are none. Repeated edges, loops
    and edges with a null end count for nothing; starts of no edge, and repeated ones, do no harm.
    """
    spark = edges.sparkSession
    root = f"{shared(spark)}/expand-{uuid.uuid4().hex}"
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = ends.union(ends.select("b", "a")).distinct()
    if most_degree is not None:
        degree = both.groupBy("a").agg(F.count("*").alias("n"))
        hub = F.col("n") > most_degree
        both = both.join(degree.select("a", hub.alias("a_hub")), "a").join(degree.select(F.col("a").alias("b"), hub.alias("b_hub")), "b")
    else:
        both = both.withColumn("a_hub", F.lit(False)).withColumn("b_hub", F.lit(False))
    both.write.parquet(f"{root}/edges")
    both = spark.read.parquet(f"{root}/edges")
    first = start.select(F.col("id").alias("start")).where("start IS NOT NULL").distinct()
    met = first.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(False).alias("hub"))
    met.write.parquet(f"{root}/met/h=0")
    kind = met.schema
    for hop in range(1, depth + 1):
        front = spark.read.schema(kind).parquet(f"{root}/met/h={hop - 1}").where("hops = 0 OR NOT hub").select("start", "node")
        # without hubs a neighbour of a node of hop h - 1 is of hop h - 2, of h - 1 or new; a hub may be met again later
        old = max(0, hop - 2) if most_degree is None else 0
        seen = spark.read.schema(kind).parquet(*[f"{root}/met/h={h}" for h in range(old, hop)])
        found = front.join(both, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), F.col("b_hub").alias("hub")).distinct()
        new = found.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(hop).alias("hops"), "hub")
        new.write.parquet(f"{root}/met/h={hop}")
        if spark.read.schema(kind).parquet(f"{root}/met/h={hop}").isEmpty():
            depth = hop
            break
    return spark.read.schema(kind).parquet(*[f"{root}/met/h={h}" for h in range(1, depth + 1)]) if depth else met.where("hops > 0")


def context(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(start, nodes, relations): what lies within depth steps of start.id, and the relations (source, type, target)
    on the way there, each once, sorted: those with an end less than depth steps away."""
    near = reachable(edges, start, depth).unionByName(start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")))
    nodes = near.where("hops > 0").groupBy("start").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    inner = near.where(F.col("hops") < depth).select("start", "node")
    e = edges.select("source", "type", "target").distinct()
    met = inner.join(e, F.col("node") == F.col("source")).union(inner.join(e, F.col("node") == F.col("target")))
    relations = met.groupBy("start").agg(F.array_sort(F.collect_set(F.struct("source", "type", "target"))).alias("relations"))
    return nodes.join(relations, "start", "full")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, statement): CREATE of nodes, then MATCH and CREATE of edges; text is escaped."""
    props = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda p: F.concat(p.key, F.lit(": "), _quoted(p.value))), ", ")
    n = nodes.select(F.lit(0).alias("ord"), F.concat(F.lit("CREATE (n:"), F.array_join("labels", ":"), F.lit(" {id: "), _quoted(F.col("id")), F.when(props != "", F.concat(F.lit(", "), props)).otherwise(""), F.lit("})")).alias("statement"))
    e = edges.select(F.lit(1).alias("ord"), F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("source")), F.lit("}), (b {id: "), _quoted(F.col("target")), F.lit("}) CREATE (a)-[:"), F.col("type"), F.lit("]->(b)")).alias("statement"))
    return n.unionByName(e)
