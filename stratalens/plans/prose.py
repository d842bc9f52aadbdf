"""The test corpus with phrases of the real vocabularies in it, so that classifiers and patterns have something to find.

Each text ends with one of PHRASES, by doc_id; view and SQL twin agree on which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import vocab
from stratalens.plans import views as V

PHRASES = [
    "We manufacture phones in China and operate plants in Germany.",
    "New tariff rules and a trade war raise currency risk.",
    "Our supply chain in Vietnam depends on supplier contracts.",
    "Cybersecurity and a data breach could harm customers.",
    "Regulatory compliance in the European Union costs more.",
    "Research and development of semiconductor products in Taiwan.",
    "Nothing of note.",
    "Sanctions, embargo and geopolitical tension; climate rules apply.",
    "Liquidity risk and competition in retail distribution.",
    "We operate factories in India. Our supply chain runs in Japan.",
    "Sales in the United States; logistics and customs duty.",
]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """views.filings with a phrase at the end of each text."""
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return V.filings(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", phrase))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PROSE = f"""{V.FILINGS}, prose AS (SELECT * REPLACE (concat_ws(' ', text, [{", ".join(map(_text, PHRASES))}][doc_id % {len(PHRASES)} + 1]) AS text) FROM filings)"""


def labels(text: str, vocabulary: dict[str, list[str]] | list[str]) -> str:
    """SQL: the sorted labels whose keywords a text contains, as tags.labels() gives them."""
    table = vocabulary if isinstance(vocabulary, dict) else {w.title(): [w] for w in vocabulary}
    hit = lambda words: " OR ".join(f"contains(lower({text}), {_text(w.lower())})" for w in words)
    cases = ", ".join(f"CASE WHEN {hit(words)} THEN {_text(label)} END" for label, words in table.items())
    return f"list_sort(list_filter([{cases}], lambda x: x IS NOT NULL))"


def knowledge_list(vocabulary: dict[str, list[str]]) -> str:
    """SQL: all labels of a company's texts, sorted, joined by |."""
    return f"array_to_string(list_sort(list_distinct(flatten(list({labels('text', vocabulary)})))), '|')"


ENTITIES = " UNION ".join(
    f"SELECT ticker, '{category}' AS category, unnest({labels('text', v)}) AS value FROM prose"
    for category, v in (("countries", vocab.FILING_COUNTRIES), ("operations", vocab.FILING_OPERATIONS), ("risk_types", vocab.FILING_RISKS))
)
