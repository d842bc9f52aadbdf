"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs.
All but the last give the columns of `documents`, whatever their names; none reads a column but doc_id, text and
source. Empty tables give no rows. Rows without a doc_id, rows that repeat, and null texts: see each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm import lines, mixing, neardup, packing, quality
from stratalens.llm.cut import cut, discard, hidden, shared_dir
from stratalens.workers import reach


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects.

    Each row is judged by its own text (null: empty, which fails the base rules), with or without a doc_id; rows that
    repeat are judged alike. Labels count for every row of their doc_id.
    """
    reach(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    statistics = cut(quality.statistics(docs), "quality-statistics")
    rules = quality.fit(statistics, labels)
    discard(statistics)
    # a second pass over the text decides where the document is: nothing is joined, no text is moved
    plain, (text,) = hidden(docs, "text")
    kept = quality.statistics(plain, text, plain.columns).where(~quality.base_failed() & rules.keeps())
    return kept.select(*plain.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that nearly repeat an earlier one; documents of which no line is left go.

    Earlier is by doc_id, then by number. Rows that repeat are one document: each of them loses the same lines. Rows
    without a doc_id, and null or empty texts, pass as they are.
    """
    reach(spark)
    return lines.remove(docs, cut(lines.find(docs).where("NOT kept"), "line-verdicts"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8): the one of the smallest doc_id.

    Of rows that share a doc_id one stays, the least in the order of all columns; rows without one all stay, as they
    name no document to compare. Texts without a word are in no group.
    """
    reach(spark)
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    plain, (key,) = hidden(left, "doc_id")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in plain.columns if c != key]))
    first = plain.where(F.col(key).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return first.union(plain.where(F.col(key).isNull())).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each time that it takes a whole one, or a part of one.

    Rows that share a doc_id, or have none, are given as often as the one of them that is taken the most. Documents
    without a word give nothing to a mix of words and go.
    """
    plain, (key, _, _) = hidden(docs, "doc_id", "text", "source")
    times = F.max(F.expr("CAST(ceil(taken / size) AS int)")).alias("_times")
    taken = mixing.mix(docs, share=1.0).where("taken > 0").groupBy(F.col("doc_id").alias("_taken")).agg(times)
    rows = plain.join(taken, F.col(key).eqNullSafe(F.col("_taken")))
    return rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*plain.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. Every row is a document of its own, also one that
    repeats or has no doc_id; a null text is the end id alone."""
    return packing.pack(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned list, components and a linear program are no SQL. tests/llm holds the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written to the shared folder and read again; a stage's table is deleted
    when the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: str | None = None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(docs)
        docs = spark.read.schema(docs.schema).parquet(path)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
