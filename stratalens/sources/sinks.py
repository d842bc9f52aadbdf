"""Sinks: tables by ticker, documents as JSON, graphs as CSV or Cypher, status tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import chunks as C
from stratalens.operators import graph as G
from stratalens.sources.tables import Table


def documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("document_type").json(path)


def companies(df: DataFrame, path: str) -> None:
    """By ticker; only the tickers at hand are overwritten."""
    dealt = df.hint("rebalance", "ticker")  # a few files a ticker, not one a ticker and task: large tickers are split
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def chunk_rows(df: DataFrame) -> DataFrame:
    """Rows as the chunk table has them: with an id, without empty texts."""
    return df.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("id", C.chunk_id(F.col("ticker"), F.col("section_type"), F.col("filing_date"), F.col("filing_type"), F.col("chunk_index")))


def append_chunks(df: DataFrame, path: str) -> None:
    chunk_rows(df).write.mode("append").partitionBy("ticker").parquet(path)


def create_chunk_table(spark, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id STRING, company_name STRING, filing_type STRING, filing_date DATE, section_type STRING, section_title STRING, sentence_idx INT, text STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP_NTZ, ticker STRING) USING parquet PARTITIONED BY (ticker)")


def fill_embeddings(df: DataFrame, embed, ticker: str | None = None) -> DataFrame:
    """Vectors for rows that have none (of one ticker, if given); others stay. embed: text Column to vector Column."""
    missing = F.col("embedding").isNull()
    missing = missing & (F.col("ticker") == ticker) if ticker else missing
    return df.withColumn("embedding", F.when(missing, embed(F.col("text"))).otherwise(F.col("embedding")))


def without_company(df: DataFrame, ticker: str) -> DataFrame:
    return df.where(~F.col("ticker").eqNullSafe(ticker))


CHUNKS = "id string, company_name string, filing_type string, filing_date date, section_type string, section_title string, sentence_idx int, text string, embedding array<float>, ticker string"


def chunk_table(spark: SparkSession, path: str) -> Table:
    """The stored table of chunks, in partitions by ticker."""
    return Table(spark, path, CHUNKS, "ticker")


def fill_stored_embeddings(table: Table, embed: Callable[[Column], Column], ticker: str | None = None) -> int:
    """Vectors for the stored chunks that have none (of one ticker, if given); returns how many. Only partitions with
    such chunks are written anew; until the commit, and if a task fails, readers see the old ones."""
    return table.fill("embedding", embed(F.col("text")).cast("array<float>"), None if ticker is None else [ticker])


def delete_company(table: Table, ticker: str) -> int:
    """The stored chunks of a company go; returns how many there were."""
    return table.delete(F.col("ticker").eqNullSafe(ticker), [ticker])


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str) -> bool:
    """json, csv or cypher; False for another format."""
    if form == "json":
        nodes.write.mode("overwrite").json(f"{path}/nodes")
        edges.write.mode("overwrite").json(f"{path}/relationships")
    elif form == "csv":
        nodes.select("id", F.array_join("labels", "|").alias("labels"), F.to_json("properties").alias("properties")).write.mode("overwrite").option("header", "true").csv(f"{path}/nodes")
        edges.select("source", "target", "type", F.array_join("evidence", "|").alias("evidence"), F.coalesce("confidence", F.lit(0.5)).alias("confidence")).write.mode("overwrite").option("header", "true").csv(f"{path}/relationships")
    elif form == "cypher":
        G.cypher(nodes, edges).orderBy("ord", "statement").select("statement").write.mode("overwrite").text(path)
    else:
        return False
    return True


def record_status(df: DataFrame, path: str) -> None:
    """(ticker, status, at) appended to the status table."""
    df.write.mode("append").parquet(path)


def open_tickers(wanted: DataFrame, status: DataFrame) -> DataFrame:
    """Tickers whose latest status is not processed."""
    done = status.groupBy("ticker").agg(F.max_by("status", "at").alias("_s")).where("_s = 'processed'")
    return wanted.join(done, "ticker", "left_anti")


def counters(status: Column) -> list[Column]:
    return [F.count("*").alias("total"), *[F.count_if(status == s).alias(s) for s in ("successful", "failed", "skipped")]]


def results(df: DataFrame, path: str) -> None:
    """Results of a run (of a batch, a search, scores) as JSON lines, one file: they are as many as what was asked for."""
    df.coalesce(1).write.mode("overwrite").json(path)


def summary(status: DataFrame) -> DataFrame:
    """One row of a run's statuses (ticker, status): counts, and the share that was successful in percent."""
    row = status.agg(*counters(F.col("status")))
    return row.withColumn("success_rate", F.when(F.col("total") > 0, F.round(F.col("successful") * 100 / F.col("total"), 1)).otherwise(0.0))
