"""Merging filings into per-company views: sections, timeline, entities, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import tags, vocab


def latest(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group: a rank limit, which Spark applies before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def section_group(filing_type: Column, section_id: Column, title: Column) -> Column:
    """risk_factors, business, significant_events or other."""
    low, sid = F.lower(F.coalesce(title, F.lit(""))), F.coalesce(section_id, F.lit(""))
    business = (sid == "item_1") | (sid.startswith("item_1") & ~sid.rlike("^item_1[abc]")) | (low.contains("business") & ~low.contains("risk") & ~low.contains("financial"))
    risk = sid.startswith("item_1a") | low.contains("risk factor")
    return F.when(filing_type == "8-K", "significant_events").when((filing_type == "10-K") & business, "business").when(risk, "risk_factors").otherwise("other")


def merge_sections(filings: DataFrame) -> DataFrame:
    """Of each company: the latest 10-K, all 10-Qs and the five latest 8-Ks, sections exploded and grouped.

    filings: ticker, filing_type, filing_date, source_file, sections. Dates compare as text; ties by source_file.
    """
    order = [F.desc("filing_date"), F.asc("source_file")]
    kept = latest(filings.where("filing_type = '10-K'"), ["ticker"], order).unionByName(filings.where("filing_type = '10-Q'")).unionByName(latest(filings.where("filing_type = '8-K'"), ["ticker"], order, 5))
    rows = kept.select("ticker", "filing_type", "filing_date", "source_file", F.posexplode("sections").alias("pos", "s"))
    return rows.select("ticker", section_group(F.col("filing_type"), F.col("s.section_id"), F.col("s.title")).alias("section_type"), "pos", "s.section_id", "s.title", "s.text", "filing_type", "filing_date", "source_file")


def company_view(filings: DataFrame) -> DataFrame:
    """One row a company: counts by form, first and last date, the latest name, its sources in order."""
    kind = lambda k: F.count_if(F.col("filing_type") == k).alias(f"n_{k.lower().replace('-', '')}")
    return filings.groupBy("ticker").agg(
        F.count("*").alias("n_filings"), kind("10-K"), kind("10-Q"), kind("8-K"), F.min("filing_date").alias("first_filing"), F.max("filing_date").alias("last_filing"),
        F.coalesce(F.max_by("company", F.struct("filing_date", "source_file")), F.first("ticker")).alias("company"), F.array_sort(F.collect_set("source_file")).alias("sources"),
    )


def timeline(filings: DataFrame) -> DataFrame:
    """(ticker, pos, date, type, source_file): latest first; of a date, 10-K before 10-Q before 8-K."""
    order = F.when(F.col("filing_type") == "10-K", 0).when(F.col("filing_type") == "10-Q", 1).otherwise(2)
    pos = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("filing_date"), order, "source_file"))
    return filings.select("ticker", pos.alias("pos"), F.col("filing_date").alias("date"), F.col("filing_type").alias("type"), "source_file")


def entities(sections: DataFrame) -> DataFrame:
    """(ticker, category, value): countries, operations and, from sections on risk, risk types. Distinct."""
    risky = F.lower(F.coalesce("title", F.lit(""))).contains("risk")
    names = tags.labels_of(F.col("text"), {"countries": vocab.FILING_COUNTRIES, "operations": vocab.FILING_OPERATIONS, "risk_types": vocab.FILING_RISKS})
    rows = sections.select("ticker", risky.alias("_risky"), names.alias("_n"))
    found = F.map_from_arrays(
        F.array(*map(F.lit, ("countries", "operations", "risk_types"))),
        F.array("_n.countries", "_n.operations", F.when(F.col("_risky"), F.col("_n.risk_types")).otherwise(F.array().cast("array<string>"))),
    )
    return rows.select("ticker", F.explode(found).alias("category", "values")).select("ticker", "category", F.explode("values").alias("value")).distinct()


def with_defaults(companies: DataFrame, view: DataFrame) -> DataFrame:
    """Every company of a list, with zero counts and empty lists where it has no filings."""
    counts = [c for c, t in view.dtypes if t in ("bigint", "int")]
    lists = [c for c, t in view.dtypes if t.startswith("array")]
    return companies.select("ticker").distinct().join(view, "ticker", "left").fillna(0, counts).withColumns({c: F.coalesce(c, F.array().cast(dict(view.dtypes)[c])) for c in lists})


def enrich(companies: DataFrame, metadata: DataFrame) -> DataFrame:
    """Names, sectors and industries filled where they are empty; lists united and sorted. One row of metadata a ticker."""
    extra = metadata.select("ticker", *[F.col(c).alias(f"_{c}") for c in ("company", "sector", "industry", "countries", "operations", "risk_types")])
    none = F.array().cast("array<string>")
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in ("company", "sector", "industry")}
    unite = {c: F.array_sort(F.array_union(F.coalesce(c, none), F.coalesce(f"_{c}", none))) for c in ("countries", "operations", "risk_types")}
    return companies.join(extra, "ticker", "left").withColumns(fill | unite).drop(*[c for c in extra.columns if c[0] == "_"])
