"""What the service's endpoints return, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import scoring as S
from stratalens.operators import graph, models, search


def companies(chunks: DataFrame) -> DataFrame:
    return chunks.select("ticker").distinct().orderBy("ticker")


def company_filings(chunks: DataFrame, ticker: str) -> DataFrame:
    """Filings of a company with the number of their chunks, latest first."""
    own = chunks.where(F.col("ticker") == ticker)
    return own.groupBy("filing_type", "filing_date").agg(F.count("*").alias("chunks"), F.min("company_name").alias("company_name")).orderBy(F.desc("filing_date"), "filing_type")


def relevant_chunks(chunks: DataFrame, first: int = 20) -> DataFrame:
    """Risk factors and business of each company; of one that has neither, its first chunks."""
    wanted = chunks.where(F.col("section_type").isin("item_1a", "item_1", "risk_factors", "business"))
    others = chunks.join(wanted.select("ticker").distinct(), "ticker", "left_anti")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("chunk_index"))
    return wanted.unionByName(others.withColumn("_rank", rank).where(F.col("_rank") <= first).drop("_rank"))


def find(chunks: DataFrame, text: str, ticker: str | None = None, k: int = 10, least: float = 0.7, embed=models.embed) -> DataFrame:
    """The chunks most similar to a text, the threshold first. The text's vector is a literal of the plan."""
    own = chunks.where(F.col("ticker") == ticker) if ticker else chunks
    scored = own.withColumn("similarity", S.cosine(F.col("embedding"), embed(F.lit(text)))).drop("embedding")
    return search.top_k(scored, k, "id", least)


def analyze(chunks: DataFrame, company_data: DataFrame, text: str, as_of: str, probability: float = 0.5, ticker: str | None = None, k: int = 50, least: float = 0.7, embed=models.embed) -> DataFrame:
    """Score, level, ten strongest chunks and advice for the company asked for, or the one that is most similar."""
    matches = find(chunks, text, ticker, k, least, embed)
    best = matches.agg(F.max_by("ticker", F.struct("similarity", "id")).alias("ticker"))
    exposed = search.exposures(matches.join(best, "ticker"), as_of)
    scores = search.company_scores(exposed, company_data.join(best, "ticker"), probability, least)
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("exposure"), "id"))
    top = exposed.withColumn("place", rank).where("place <= 10").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("place", "id", "section_type", "similarity", "exposure"))).alias("contributors"))
    advice = S.recommendation(F.col("expected"), F.col("risk_level"), F.lit(0.0))
    return scores.join(top, "ticker", "left").withColumn("recommendation", advice).withColumn("summary", models.summary(F.lit(text)))


def recommendation_context(scores: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Scores (of the companies asked for) with the nodes and relations around each company in the graph."""
    near = graph.context(edges, scores.select(F.col("ticker").alias("id")), depth).withColumnRenamed("nodes", "neighbours")
    return scores.join(near, F.col("ticker") == F.col("start"), "left").drop("start")


def populate(chunks: DataFrame, extract=models.extract, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what a model extracts from companies' relevant chunks: at most so many suppliers,
    countries and relations a company, relations only to suppliers and sectors."""
    found = relevant_chunks(chunks).select("ticker", extract(F.col("text")).alias("x"))

    def part(field: str, label: str, relation: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("ticker").orderBy("target"))
        values = found.select("ticker", F.explode(f"x.{field}").alias("target")).distinct()
        return values.withColumn("_rank", rank).where(F.col("_rank") <= most).select(F.col("ticker").alias("source"), "target", F.lit(relation).alias("type"), F.lit(label).alias("label"))

    listed = part("suppliers", "Supplier", "SUPPLIED_BY").unionByName(part("countries", "Sector", "OPERATES_IN")).unionByName(part("sectors", "Sector", "OPERATES_IN"))
    told = found.select(F.col("ticker").alias("source"), F.explode("x.relationships").alias("r")).select("source", F.col("r.target").alias("target"), F.col("r.type").alias("type"), graph.kept_relation(F.col("r.type")).alias("label")).where("label IS NOT NULL").distinct()
    edges = listed.unionByName(told).distinct()
    nodes = edges.select(F.col("target").alias("id"), "label").union(edges.select("source", F.lit("Company"))).distinct()
    return nodes, edges.drop("label")


def complete_ticker(paths: DataFrame) -> DataFrame:
    """The first ticker (third part of the path) with all three forms, else the first with any."""
    form = F.when(F.lower("path").rlike("10-?k"), "k").when(F.lower("path").rlike("10-?q"), "q").when(F.lower("path").rlike("8-?k"), "e")
    rows = paths.select(F.get(F.split("path", "/"), 2).alias("ticker"), form.alias("form")).where("ticker IS NOT NULL AND form IS NOT NULL")
    counted = rows.groupBy("ticker").pivot("form", ["k", "q", "e"]).count().fillna(0)
    return counted.orderBy(F.desc((F.col("k") > 0) & (F.col("q") > 0) & (F.col("e") > 0)), "ticker").limit(1)
