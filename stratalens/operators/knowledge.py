"""The company knowledge table: updates, merges, look-ups, statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import tags, vocab

LISTS = ["regions", "operations", "risk_types", "keywords"]


def _none():
    return F.array().cast("array<string>")


def merge(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Lists united and sorted; name and sector: first one wins, or the new one if overwrite; sources in order."""
    n = new.select("ticker", *[F.col(c).alias(f"_{c}") for c in new.columns if c != "ticker"])
    own = lambda c: F.coalesce(*([F.col(f"_{c}"), F.col(c)] if overwrite else [F.col(c), F.col(f"_{c}")])).alias(c)
    lists = [F.array_sort(F.array_union(F.coalesce(c, _none()), F.coalesce(f"_{c}", _none()))).alias(c) for c in LISTS]
    return old.join(n, "ticker", "full").select("ticker", own("company"), own("sector"), *lists, F.array_union(F.coalesce("sources", _none()), F.coalesce("_sources", _none())).alias("sources"))


def from_sections(sections: DataFrame) -> DataFrame:
    """Knowledge that sections (ticker, text, source_file) give: distinct labels a company."""
    named = tags.labels_of(F.col("text"), {"regions": vocab.REGIONS, "operations": vocab.OPERATIONS, "risk_types": vocab.RISKS})
    found = sections.select("ticker", "source_file", named.alias("_n")).select("ticker", "source_file", "_n.*")
    flat = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("regions", "operations", "risk_types")]
    return found.groupBy("ticker").agg(F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("sector"), *flat, _none().alias("keywords"), F.array_sort(F.collect_set("source_file")).alias("sources"))


def from_profiles(profiles: DataFrame) -> DataFrame:
    """Providers' rows (ticker, rank, company, sector, country, summary): each field from the best provider that has it."""
    best = best_fields(profiles, ["company", "sector", "country", "summary"])
    named = tags.labels_of(F.col("summary"), {"regions": vocab.PROFILE_REGIONS, "operations": vocab.PROFILE_OPERATIONS, "risk_types": vocab.PROFILE_RISKS})
    best = best.withColumn("_n", named)
    home = F.when(F.upper("country").isin("US", "USA"), "United States").otherwise(F.col("country"))
    regions = F.array_distinct(F.concat(F.when(F.coalesce("country", F.lit("")) != "", F.array(home)).otherwise(_none()), F.col("_n.regions")))
    return best.select("ticker", "company", "sector", F.array_sort(regions).alias("regions"), "_n.operations", "_n.risk_types", _none().alias("keywords"), F.array(F.lit("profile")).alias("sources"))


def search(knowledge: DataFrame, region: str | None = None, operation: str | None = None, risk: str | None = None, sector: str | None = None) -> DataFrame:
    out = knowledge
    for column, value in (("regions", region), ("operations", operation), ("risk_types", risk)):
        out = out.where(F.array_contains(column, value)) if value else out
    return out.where(F.lower(F.coalesce("sector", F.lit(""))) == sector.lower()) if sector else out


def statistics(knowledge: DataFrame) -> DataFrame:
    """One row: companies, mean lengths of lists, distinct regions and operations."""
    counts = knowledge.agg(F.count("*").alias("n"), *[F.avg(F.size(c)).alias(f"avg_{c}") for c in ("regions", "operations", "risk_types")])
    distinct = knowledge.select(F.explode(F.array(F.struct(F.lit("r").alias("k"), F.col("regions").alias("v")), F.struct(F.lit("o").alias("k"), F.col("operations").alias("v")))).alias("x")).select("x.k", F.explode("x.v").alias("v")).agg(F.count_distinct(F.when(F.col("k") == "r", F.col("v"))).alias("n_regions"), F.count_distinct(F.when(F.col("k") == "o", F.col("v"))).alias("n_operations"))
    return counts.join(distinct)


def context(tickers: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Enrichment context of tickers, in upper case; unknown ones get empty lists."""
    t = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    return t.join(knowledge, "ticker", "left").withColumns({c: F.coalesce(c, _none()) for c in LISTS})


SCHEMA = "ticker string, company string, sector string, regions array<string>, operations array<string>, risk_types array<string>, keywords array<string>, sources array<string>, metadata map<string,string>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The knowledge table below path; an empty one if there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def save(knowledge: DataFrame, path: str) -> None:
    """Written as a whole. Spark refuses to overwrite what it reads, so a table that was loaded goes to a new path."""
    knowledge.write.mode("overwrite").parquet(path)


def refresh(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """old with new rows merged in by merge(); metadata of both, where the new value of a key wins."""
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("metadata", none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("_metadata", none)), k))
    both = old.select("ticker", "metadata").join(new.select("ticker", F.col("metadata").alias("_metadata")), "ticker", "full")
    data = both.select("ticker", F.map_concat(kept, F.coalesce("_metadata", none)).alias("metadata"))
    return merge(old.drop("metadata"), new.drop("metadata"), overwrite).join(data, "ticker")


def best_fields(profiles: DataFrame, fields: list[str]) -> DataFrame:
    """(ticker, fields) of providers' rows (ticker, rank, fields): each field from the best provider that has it."""
    filled = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("rank"))).alias(c) for c in fields]
    return profiles.groupBy("ticker").agg(*filled)
