"""The document pipeline: files to filings, companies, chunks with vectors; one plan for all companies."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import aggregate, chunks, models, sections
from stratalens.sources import readers, sinks


@dataclass
class Config:
    """Where things are, and what is done. from_env() reads variables of the same names, in capitals."""

    source: str = "input"
    output: str = "output"
    sentences_per_chunk: int = 3
    skip_embeddings: bool = False
    dry_run: bool = False

    @classmethod
    def from_env(cls) -> Config:
        given = {f: os.environ[f.upper()] for f in cls.__dataclass_fields__ if f.upper() in os.environ}
        return cls(**{k: v if k in ("source", "output") else int(v) if k == "sentences_per_chunk" else v.lower() == "true" for k, v in given.items()})


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections of filings and of legislation among files; CSVs and files that no parser takes are left out."""
    kinds = files.withColumn("_kind", T.document_kind(F.col("path")))
    filings = sections.filings(kinds.where("_kind = 'html_filing'").drop("_kind"))
    laws = sections.legislation(kinds.where(F.col("_kind").isin("html_legislation", "xml_legislation")).drop("_kind"))
    return filings, laws


def company_sections(filings: DataFrame) -> DataFrame:
    """Merged sections of each company."""
    whole = filings.where("error IS NULL AND section IS NOT NULL").groupBy("path", "ticker", "company", "filing_type", "filing_date").agg(F.array_sort(F.collect_list(F.struct("pos", "section"))).alias("_s"))
    rows = whole.withColumn("sections", F.transform("_s", lambda x: x.section)).withColumn("source_file", T.base_name(F.col("path"))).drop("_s")
    return aggregate.merge_sections(rows)


def vector_chunks(merged: DataFrame, size: int = 3, embed=models.embed) -> DataFrame:
    keep = ["ticker", "section_type", "pos", "title", "filing_type", "filing_date", "source_file"]
    return chunks.sentence_chunks(merged, keep, size=size).withColumn("embedding", embed(F.col("chunk_text")))


def can_run(spark: SparkSession, config: Config) -> dict[str, bool]:
    """Which stages have what they need: a source that can be listed, and before embeddings an output to write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(config.source)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return {"parse": there, "aggregate": there, "embeddings": there and bool(config.output) and not config.skip_embeddings}


def run(spark: SparkSession, config: Config) -> dict[str, str]:
    """What was done: success, planned, skipped or failed (with the reason), by stage. A stage that fails does not end
    the run; stages that need what it should have written are skipped. A dry run plans only."""
    stages = {"parse": "legislation", "aggregate": "companies", "embeddings": "chunks"}
    ready = can_run(spark, config)
    if not ready["parse"]:
        return dict.fromkeys(stages, "skipped")
    filings, laws = parsed(readers.files(spark, config.source))
    merged = company_sections(filings)
    if config.dry_run:
        return dict.fromkeys(stages, "planned")

    def embeddings() -> None:
        stored = spark.read.parquet(f"{config.output}/companies")
        sinks.companies(vector_chunks(stored, config.sentences_per_chunk), f"{config.output}/chunks")

    work = {
        "parse": lambda: laws.write.mode("overwrite").parquet(f"{config.output}/legislation"),
        "aggregate": lambda: sinks.companies(merged, f"{config.output}/companies"),
        "embeddings": embeddings,
    }
    done: dict[str, str] = {}
    for stage, job in work.items():
        if not ready[stage] or stage == "embeddings" and done["aggregate"] != "success":
            done[stage] = "skipped"
            continue
        try:
            job()
            done[stage] = "success"
        except Exception as e:  # whatever a stage meets is its status
            done[stage] = f"failed: {type(e).__name__}"
    return done


def inspect(merged: DataFrame) -> DataFrame:
    """Sections, words and characters by company and section type."""
    return merged.groupBy("ticker", "section_type").agg(F.count("*").alias("sections"), F.sum(T.word_count(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("chars"))
