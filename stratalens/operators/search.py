"""Exact vector search, and risk scores of companies from its matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import scoring as S


def similarities(chunks: DataFrame, queries: DataFrame, embedding: str = "embedding") -> DataFrame:
    """chunks with query_id and similarity to each query vector (query_id, query_embedding). Queries are a stated
    set; the chunks are scanned once and the vector is not carried on."""
    return chunks.join(queries).withColumn("similarity", S.cosine(F.col(embedding), F.col("query_embedding"))).drop("query_embedding", embedding)


def top_k(matches: DataFrame, k: int, key: str, least: float | None = None, by: list[str] = ()) -> DataFrame:
    """The k most similar rows of each group, the threshold first; ties by key."""
    rows = matches if least is None else matches.where(F.col("similarity") >= least)
    if not by:
        return rows.orderBy(F.desc("similarity"), key).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def exposures(matches: DataFrame, as_of: str) -> DataFrame:
    """matches (similarity, section_type, filing_date, text) with weight and exposure."""
    w = S.section_weight(F.col("section_type")) * S.recency_weight(F.col("filing_date"), F.lit(as_of).cast("date")) * S.size_weight(F.col("text"))
    return matches.withColumn("weight", w).withColumn("exposure", F.col("similarity") * F.col("weight"))


def company_scores(exposed: DataFrame, companies: DataFrame, probability: float, least: float = 0.0) -> DataFrame:
    """(ticker, raw, sensitivity, adjusted, expected, worst, risk_level, n_matches) of every company; no match: 0, low."""
    raw = exposed.where(F.col("similarity") >= least).groupBy("ticker").agg(S.raw_score(F.col("similarity"), F.col("weight")).alias("raw"), F.count("*").alias("n_matches"))
    s = S.sensitivity(F.col("revenue_exposed"), F.col("margin_sensitivity"), F.col("supply_dependency"))
    rows = companies.select("ticker", s.alias("sensitivity")).join(raw, "ticker", "left").fillna(0, ["raw", "n_matches"])
    adjusted = F.col("raw") * F.col("sensitivity")
    return rows.withColumn("adjusted", adjusted).withColumn("expected", F.col("adjusted") * probability).withColumn("worst", F.col("adjusted")).withColumn("risk_level", S.risk_class(F.col("expected")))


def match_statistics(matches: DataFrame) -> DataFrame:
    """Counts, means and maxima over all, by section_type and by filing_type, in one pass of grouping sets."""
    return matches.groupingSets([[], [F.col("section_type")], [F.col("filing_type")]], F.col("section_type"), F.col("filing_type")).agg(F.count("*").alias("n"), F.avg("similarity").alias("avg_similarity"), F.max("similarity").alias("max_similarity"), F.min("similarity").alias("min_similarity"))


def impact(matches: DataFrame, by: str = "ticker") -> DataFrame:
    """(by, impact_score, impact_level): the older score, a mean of weighted similarities."""
    score = F.least(F.avg(F.col("similarity") * S.impact_weight(F.col("section_type"))) / 1.5, F.lit(1.0))
    return matches.groupBy(by).agg(score.alias("impact_score")).withColumn("impact_level", S.impact_level(F.col("impact_score")))


def explanation(rows: DataFrame) -> DataFrame:
    """ticker, legislation_id, impact_score, impact_level, n, avg_similarity, max_similarity -> explanation text."""
    f3 = lambda c: F.format_string("%.3f", F.col(c))
    meaning = F.when(F.col("impact_level") == "high", "Disclosures resemble the text closely: a strong effect is likely.").when(F.col("impact_level") == "medium", "Disclosures and the text overlap in part: the matches deserve a look.").otherwise("Disclosures hardly resemble the text: little effect is likely.")
    text = F.concat_ws("\n", F.concat(F.lit("IMPACT ASSESSMENT: "), F.upper("impact_level"), F.lit(" RISK")), F.concat(F.lit("Legislation: "), F.col("legislation_id")), F.concat(F.lit("Company: "), F.col("ticker")), F.concat(F.lit("Score: "), f3("impact_score")), F.concat(F.lit("Matches: "), F.col("n").cast("string"), F.lit(", mean "), f3("avg_similarity"), F.lit(", most "), f3("max_similarity")), meaning)
    return rows.withColumn("explanation", text)


def mean_pool(df: DataFrame, by: str, embedding: str = "embedding") -> DataFrame:
    """(by, pos, value): the mean vector of each group, long: partial sums by place before the shuffle."""
    return df.select(by, F.posexplode(embedding).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
