"""The driver's tables in the roles of the engine: filings, chunks, companies, edges. Each view has a SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as filings: the source is the company, form, date and section follow from doc_id."""
    d = table(spark, sf_dir, "documents")
    form = F.get(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (F.col("doc_id") % 3).cast("int"))
    section = F.get(F.array(F.lit("risk_factors"), F.lit("business"), F.lit("significant_events"), F.lit("other")), (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", F.col("source").alias("ticker"), form.alias("filing_type"), F.date_sub(F.lit("2024-12-31").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("filing_date"), section.alias("section_type"), "text", "lang", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source_file"))


FILINGS = """filings AS (SELECT doc_id, source AS ticker, CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS filing_type,
 CAST(DATE '2024-12-31' - CAST(doc_id % 900 AS INTEGER) AS DATE) AS filing_date,
 CASE doc_id % 4 WHEN 0 THEN 'risk_factors' WHEN 1 THEN 'business' WHEN 2 THEN 'significant_events' ELSE 'other' END AS section_type,
 text, lang, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS source_file FROM documents)"""


def matches(spark: SparkSession, sf_dir: str, query: int = 0) -> DataFrame:
    """embeddings as chunks of companies (by label), with the similarity to one of them."""
    from stratalens.functions.scoring import cosine

    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where(F.col("vec_id") == query).select(F.col("embedding").alias("q")))  # one vector
    section = F.get(F.array(F.lit("risk_factors"), F.lit("business"), F.lit("significant_events"), F.lit("other")), (F.col("vec_id") % 4).cast("int"))
    form = F.get(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (F.col("vec_id") % 3).cast("int"))
    rows = e.where(F.col("vec_id") != query).join(q)
    return rows.select("vec_id", F.concat(F.lit("T"), F.col("label").cast("string")).alias("ticker"), section.alias("section_type"), form.alias("filing_type"), F.date_sub(F.lit("2024-12-31").cast("date"), (F.col("vec_id") % 900).cast("int")).alias("filing_date"), F.repeat(F.lit("x"), (F.col("vec_id") % 5000).cast("int")).alias("text"), cosine(F.col("embedding"), F.col("q")).alias("similarity"))


MATCHES = """matches AS (SELECT e.vec_id, 'T' || CAST(e.label AS VARCHAR) AS ticker,
 CASE e.vec_id % 4 WHEN 0 THEN 'risk_factors' WHEN 1 THEN 'business' WHEN 2 THEN 'significant_events' ELSE 'other' END AS section_type,
 CASE e.vec_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS filing_type,
 CAST(DATE '2024-12-31' - CAST(e.vec_id % 900 AS INTEGER) AS DATE) AS filing_date, e.vec_id % 5000 AS text_length,
 list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
 FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0)"""

EXPOSED = (
    MATCHES
    + """, exposed AS (SELECT *, (CASE section_type WHEN 'risk_factors' THEN 1.0 WHEN 'significant_events' THEN 0.95 WHEN 'business' THEN 0.6 ELSE 0.5 END)
 * exp(-0.001 * greatest(date_diff('day', filing_date, DATE '2024-12-31'), 0))
 * (CASE WHEN text_length = 0 THEN 0.5 ELSE greatest(0.1, least(1.0, text_length / 4.0 / 1000)) END) AS weight FROM matches)"""
)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies of matches with what sensitivity needs: T0..T9 and one without a match."""
    rows = spark.range(11).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"), (F.col("id") / 10).alias("revenue_exposed"), F.when(F.col("id") % 2 == 0, F.col("id") / 20).alias("margin_sensitivity"), F.when(F.col("id") % 3 == 0, F.lit(0.5)).alias("supply_dependency"))
    return rows


COMPANIES = """companies AS (SELECT 'T' || CAST(id AS VARCHAR) AS ticker, id / 10.0 AS revenue_exposed, CASE WHEN id % 2 = 0 THEN id / 20.0 END AS margin_sensitivity, CASE WHEN id % 3 = 0 THEN 0.5 END AS supply_dependency FROM range(11) r(id))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, nations and regions as a graph."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    supply = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target"), F.lit("OPERATES_IN").alias("type"))
    return supply.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("target"), F.lit("PART_OF").alias("type")))


EDGES = """edges AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS source, 'n' || CAST(s_nationkey AS VARCHAR) AS target, 'OPERATES_IN' AS type FROM supplier
 UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), 'PART_OF' FROM nation JOIN region ON n_regionkey = r_regionkey)"""
