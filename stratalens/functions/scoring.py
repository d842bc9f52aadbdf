"""Scoring mathematics of exposure and risk. Column expressions in double precision; the date is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions import vocab


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; 0 if either vector is (nearly) zero."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(_clamp(dot(a, b) / (na * nb + 1e-12), -1.0, 1.0))


def section_weight(kind: Column) -> Column:
    out = F
    for name, weight in vocab.SECTION_WEIGHTS.items():
        out = out.when(F.lower(kind) == name, weight)
    return out.otherwise(0.5)


def impact_weight(kind: Column) -> Column:
    out = F
    for name, weight in vocab.IMPACT_WEIGHTS.items():
        out = out.when(kind == name, weight)
    return out.otherwise(0.8)


def recency_weight(date: Column, as_of: Column) -> Column:
    """exp(-rate * age in days); 1 for the future, 0.5 for no date."""
    age = F.greatest(F.datediff(as_of, date), F.lit(0))
    return F.when(date.isNull(), 0.5).otherwise(F.exp(-vocab.RECENCY_RATE * age))


def size_weight(text: Column) -> Column:
    """About the number of thousand tokens, in [0.1, 1]; 0.5 for no text."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.5).otherwise(_clamp(n / 4 / vocab.TOKENS_BASE, 0.1, 1.0))


def similarity_or(precomputed: Column, embedding: Column, query: Column) -> Column:
    return F.when((F.coalesce(precomputed, F.lit(0.0)) == 0.0) & embedding.isNotNull(), cosine(embedding, query)).otherwise(F.coalesce(precomputed, F.lit(0.0)))


def raw_score(similarity: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean of similarities, in [0, 1]."""
    return F.coalesce(_clamp(F.sum(similarity * weight) / (F.sum(weight) + 1e-12), 0.0, 1.0), F.lit(0.0))


def revenue_exposed(by_region: Column, affected: Column, countries: Column) -> Column:
    """Affected share of revenue, where regions and affected regions are known; else a guess from countries."""
    total = F.aggregate(F.map_values(by_region), F.lit(0.0), lambda s, x: s + x)
    hit = F.aggregate(F.map_values(F.map_filter(by_region, lambda k, _: F.array_contains(affected, k))), F.lit(0.0), lambda s, x: s + x)
    risky = F.exists(F.coalesce(countries, F.array().cast("array<string>")), lambda c: F.lower(c).isin(*vocab.HIGH_RISK_COUNTRIES))
    known = (F.size(F.coalesce(by_region, F.create_map().cast("map<string,double>"))) > 0) & (F.size(F.coalesce(affected, F.array().cast("array<string>"))) > 0)
    return F.when(known & (total > 0), hit / F.nullif(total, F.lit(0.0))).when(risky, 0.4).otherwise(0.2)


def sensitivity(revenue: Column, margin: Column, supply: Column) -> Column:
    return _clamp(0.6 * revenue + 0.3 * F.coalesce(margin, F.lit(0.2)) + 0.1 * F.coalesce(supply, F.lit(0.0)), 0.0, 1.0)


def risk_class(expected: Column) -> Column:
    out = F
    for at, name in vocab.RISK_BANDS:
        out = out.when(expected >= at, name)
    return out.otherwise("low")


def recommendation(score: Column, level: Column, market_cap: Column) -> Column:
    """struct<action, reduction, hedge, monitoring, advice>."""

    def advice(action: str, reduction: Column, hedge: Column, monitoring: str, *lines: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), reduction.cast("double").alias("reduction"), hedge.alias("hedge"), F.lit(monitoring).alias("monitoring"), F.array(*lines).alias("advice"))

    cut, trim = F.least(F.lit(0.8), 0.6 * score), F.least(F.lit(0.4), 0.3 * score)
    percent = lambda c: F.bround(c * 100, 0).cast("int").cast("string")
    return (
        F.when(level == "critical", advice("reduce_weight_aggressively", cut, F.lit(True), "immediate_analyst_review", F.concat(F.lit("Cut the position by at most "), percent(cut), F.lit("%")), F.lit("Buy puts or short the sector"), F.lit("Have counsel look at it now"), F.lit("Watch news and filings every day")))
        .when(level == "high", advice("trim_position", trim, F.lit(True), "daily", F.concat(F.lit("Cut the position by "), percent(trim), F.lit("%")), F.lit("Hedge in part"), F.lit("Watch news and filings every day")))
        .when(level == "medium", advice("monitor_closely", F.lit(0.0), F.coalesce(market_cap, F.lit(0.0)) > 1e9, "set_alerts", F.lit("Leave the position as it is"), F.lit("Set alerts"), F.lit("Hedge a little if the position is large")))
        .otherwise(advice("no_action", F.lit(0.0), F.lit(False), "normal", F.lit("Nothing to do"), F.lit("Watch as usual")))
    )


def impact_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def kelly(p: Column, odds: Column) -> Column:
    """The stake that maximises growth: (p * b - (1 - p)) / b, not below 0."""
    return F.greatest(F.lit(0.0), (p * odds - (1 - p)) / odds)


def market_probability(outcomes: Column, probability: Column) -> Column:
    """The price of the outcome Yes (0.5 without a price), else the market's own probability, else 0.5."""
    yes = F.filter(outcomes, lambda o: o.outcome == "Yes")
    return F.when(F.size(F.coalesce(yes, F.array())) > 0, F.coalesce(F.get(yes, 0)["price"], F.lit(0.5))).otherwise(F.coalesce(probability, F.lit(0.5)))
