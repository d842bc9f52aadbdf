"""Parsed documents to chunks, and chunks to the rows of the chunk table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import lemmas
from stratalens.functions import text as T
from stratalens.operators import chunks, enrich


def process(sections: DataFrame, keep: list[str], knowledge: DataFrame | None = None, size: int = 512, overlap: int = 50, last: Callable[[Column], Column] | None = None, lemmatise: bool = False, stop_words: Sequence[str] = ()) -> DataFrame:
    """keep, section_title and chunks of sections (title, text, document_type, ticker): markup out and text cleaned,
    filings with the context of their company, regulations with theirs (jurisdiction, type, identifier), white space
    normalised, words replaced by their lemmas without stop words if asked for, a last step if one is given, then cut.

    knowledge: what enrich.filing_chunks() asks for; without it, nothing is enriched.
    """
    rows = sections.withColumn("text", T.strip_tags(F.col("text"))).withColumnRenamed("title", "section_title")
    if knowledge is not None:
        rows = enrich.filing_chunks(rows, knowledge)
        has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        regulation = enrich.regulation_text(F.col("text"), has("jurisdiction"), has("type"), has("identifier"))
        kind = F.col("document_type")
        enriched = F.when(kind == "html_filing", F.col("enriched_text")).when(kind == "html_legislation", regulation).otherwise(F.col("text"))
        rows = rows.withColumn("text", enriched).drop("enriched_text")
    text = T.normalize(F.col("text"))
    text = lemmas.lemmas(text, stop_words) if lemmatise else text
    rows = rows.withColumn("text", last(text) if last else text)
    return chunks.split_chunks(rows.select(*keep, "section_title", "text"), [*keep, "section_title"], size=size, overlap=overlap)


def company_rows(companies: DataFrame) -> DataFrame:
    """One chunk a company of a table of metrics: its names and metrics as text."""
    metrics = F.transform(F.array_sort(F.map_entries("metrics")), lambda m: F.concat(m.key, F.lit(": "), m.value.cast("string")))
    text = F.concat_ws(" ", F.concat(F.lit("Company: "), F.coalesce("company", F.lit(""))), F.concat(F.lit("Ticker: "), F.col("ticker")), F.array_join(metrics, " "))
    return companies.withColumns({"text": text, "chunk_index": F.lit(0), "total_chunks": F.lit(1)})


def warehouse(chunk_rows: DataFrame) -> DataFrame:
    """Chunks (section_title, text, filing_type, filing_date, chunk_index, total_chunks) as the chunk table has them."""
    given = [c for c in chunk_rows.columns if c not in ("section_type", "chunk_index", "total_chunks", "filing_type", "filing_date")]
    return chunk_rows.select(
        *given, T.section_kind(F.col("section_title")).alias("section_type"),
        F.coalesce("filing_type", F.lit("N/A")).alias("filing_type"), F.coalesce("filing_date", F.lit("")).alias("filing_date"),
        F.coalesce("chunk_index", F.lit(0)).alias("sentence_idx"), F.coalesce("total_chunks", F.lit(0)).alias("total_sentences"), F.col("text").alias("original_sentence"),
    )


def as_json(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and a JSON object of all other columns that are not null."""
    return rows.select(*keep, F.to_json(F.struct(*[c for c in rows.columns if c not in keep])).alias("json"))
