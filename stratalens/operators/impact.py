"""Impact of a text on companies: search, threshold, scores, matches, statistics and explanation as one plan.

Companies are rows throughout; nothing is looped over on the driver. A company without data is reported as unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import scoring as S
from stratalens.operators import search


def _whole(c: Column) -> Column:
    """A whole number that may come as text; anything else is 0."""
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(0))


def position(index: Column, total: Column) -> Column:
    """Where a sentence stands: its number from 1, and of how many if that is known."""
    i, n = _whole(index), _whole(total)
    return F.when(n > 0, F.concat_ws(" of ", (i + 1).cast("string"), n.cast("string"))).otherwise((i + 1).cast("string"))


def formatted(matches: DataFrame) -> DataFrame:
    """matches with sentence_idx and total_sentences as numbers (0 if they are none) and sentence_position."""
    place = position(F.col("sentence_idx"), F.col("total_sentences"))
    return matches.withColumns({"sentence_position": place, "sentence_idx": _whole(F.col("sentence_idx")), "total_sentences": _whole(F.col("total_sentences"))})


def statistics(matches: DataFrame, by: list[str]) -> DataFrame:
    """by, total_matches, avg, max and min similarity, and by_section: array of (section_type, count, avg, max), sorted."""
    parts = matches.groupBy(*by, "section_type").agg(
        F.count("*").alias("count"), F.sum("similarity").alias("_sum"), F.max("similarity").alias("_max"), F.min("similarity").alias("_min")
    )
    section = F.struct("section_type", "count", (F.col("_sum") / F.col("count")).alias("avg_similarity"), F.col("_max").alias("max_similarity"))
    return parts.groupBy(*by).agg(
        F.sum("count").alias("total_matches"),
        (F.sum("_sum") / F.sum("count")).alias("avg_similarity"),
        F.max("_max").alias("max_similarity"),
        F.min("_min").alias("min_similarity"),
        F.array_sort(F.collect_list(section)).alias("by_section"),
    )


def _shown(c: Column) -> Column:
    return F.format_string("%.3f", c)


def _match_lines(m: Column, i: Column) -> Column:
    """Four lines on a match and an empty one."""
    text = F.when(F.length(m.text) > 200, F.concat(F.substring(m.text, 1, 200), F.lit("..."))).otherwise(F.coalesce(m.text, F.lit("")))
    return F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.coalesce(m.section_title, F.lit("")), F.lit(" (similarity: "), _shown(m.similarity), F.lit(")\n     Sentence "),
        m.sentence_position, F.lit(" in "), m.section_type, F.lit(" section\n     From "), m.filing_type, F.lit(" filed "), m.filing_date.cast("string"), F.lit('\n     "'), text, F.lit('"\n'),
    )


def explanation(legislation: Column) -> Column:
    """The text for people, of columns ticker, company, risk_level, expected, statistics and matches."""
    interpretation = (
        F.when(F.col("risk_level").isin("critical", "high"), "Disclosures resemble the text closely: a strong effect is likely.")
        .when(F.col("risk_level") == "medium", "Disclosures and the text overlap in part: the matches deserve a look.")
        .otherwise("Disclosures hardly resemble the text: little effect is likely.")
    )
    sections = F.transform("by_section", lambda s: F.concat(F.lit("  - "), s.section_type, F.lit(": "), s["count"].cast("string"), F.lit(" matches, avg similarity "), _shown(s.avg_similarity)))
    shown = F.transform(F.slice("matches", 1, 5), _match_lines)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("IMPACT ASSESSMENT: "), F.upper("risk_level"), F.lit(" RISK\n")),
        F.concat(F.lit("Legislation: "), legislation),
        F.concat(F.lit("Company: "), F.coalesce("company", "ticker"), F.lit(" ("), F.col("ticker"), F.lit(")")),
        F.concat(F.lit("Overall Impact Score: "), _shown(F.col("expected")), F.lit("\n")),
        F.concat(F.lit("Matches: "), F.col("total_matches").cast("string"), F.lit(", average "), _shown(F.col("avg_similarity")), F.lit(", maximum "), _shown(F.col("max_similarity")), F.lit("\n")),
        F.when(F.size("by_section") > 0, F.concat(F.lit("Similarity by Section Type:\n"), F.array_join(sections, "\n"), F.lit("\n"))),
        F.when(F.size("matches") > 0, F.concat(F.lit("Most Relevant Matches:\n"), F.array_join(shown, "\n"))),
        F.lit("Risk Interpretation:"),
        interpretation,
    )


def score_details(probability: float) -> Column:
    """The explanation for programs: a struct of the score's parts. A missing margin counts 0 here, unlike in the score."""
    return F.struct(
        F.concat(F.lit("Risk Level: "), F.upper("risk_level"), F.lit(", Score: "), _shown(F.col("expected"))).alias("summary"),
        F.col("raw").alias("raw_score"),
        F.struct(
            F.col("sensitivity").alias("overall_sensitivity"), "revenue_exposed",
            F.coalesce("margin_sensitivity", F.lit(0.0)).alias("margin_sensitivity"), F.coalesce("supply_dependency", F.lit(0.0)).alias("supply_chain_dependency"),
        ).alias("sensitivity_breakdown"),
        F.struct(F.lit(probability).alias("polymarket_probability"), F.col("expected").alias("expected_score"), F.col("worst").alias("worst_case_score")).alias("adjustments"),
        F.struct("total_matches", F.map_from_entries(F.transform("by_section", lambda s: F.struct(s.section_type, s["count"]))).alias("section_breakdown")).alias("statistics"),
    )


def analyze(matches: DataFrame, companies: DataFrame, legislation: str, as_of: str, probability: float = 1.0, k: int = 50, least: float = 0.7, tickers: DataFrame | None = None) -> DataFrame:
    """A row for each company asked for (tickers, else companies): scores, matches, statistics, advice, explanations.

    matches: id, ticker, similarity, section_type, section_title, filing_type, filing_date, text, sentence_idx,
    total_sentences; of each company the k most similar count, those under the threshold left out. companies: ticker,
    company, revenue_exposed, margin_sensitivity, supply_dependency. A company that is asked for but not known has
    risk_level unknown and score 0; one without a match has score 0 and risk_level low.
    """
    near = search.top_k(matches, k, "id", by=["ticker"]).where(F.col("similarity") >= least)
    near = formatted(search.exposures(near, as_of))
    scores = search.company_scores(near, companies, probability, least).drop("n_matches", "sensitivity")
    one = F.struct((-F.col("similarity")).alias("_order"), "id", "similarity", "section_type", "section_title", "filing_type", "filing_date", "sentence_position", "text", "exposure")
    listed = near.groupBy("ticker").agg(F.array_sort(F.collect_list(one)).alias("matches"))
    rows = companies.join(scores, "ticker").join(statistics(near, ["ticker"]), "ticker", "left").join(listed, "ticker", "left")
    rows = rows.fillna(0, ["total_matches", "avg_similarity", "max_similarity", "min_similarity"])
    rows = rows.withColumn("sensitivity", S.sensitivity(F.col("revenue_exposed"), F.col("margin_sensitivity"), F.col("supply_dependency")))
    rows = rows.withColumns({"by_section": F.coalesce("by_section", F.array()), "matches": F.coalesce("matches", F.array())})
    rows = rows.withColumn("matches", F.transform("matches", lambda m: m.dropFields("_order")))
    rows = rows.withColumns({"recommendation": S.recommendation(F.col("expected"), F.col("risk_level"), F.lit(0.0)), "details": score_details(probability), "explanation": explanation(F.lit(legislation))})
    if tickers is None:
        return rows
    asked = tickers.select("ticker").distinct().join(rows, "ticker", "left")
    return asked.withColumn("risk_level", F.coalesce("risk_level", F.lit("unknown"))).fillna(0, ["expected", "total_matches"])


def report(matches: DataFrame, k: int = 10) -> DataFrame:
    """The similarity report: one row of overall mean and maximum, sections with count, mean and maximum, and the k
    most similar matches."""
    overall = statistics(matches.withColumn("_all", F.lit(1)), ["_all"])
    top = search.top_k(matches, k, "id").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("_order"), "id", "similarity"))).alias("top"))
    top = top.withColumn("top", F.transform("top", lambda m: F.struct(m.id.alias("id"), m.similarity.alias("similarity"))))
    return overall.drop("_all").join(F.broadcast(top))  # one row each
