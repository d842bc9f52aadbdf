"""Language by profiles of character trigrams, learned from labelled texts.

Trigrams of lower-cased whole texts are counted by language as Spark aggregates; the model keeps the `most` commonest of
them all, with a smoothed log-likelihood for each language, and one for every other trigram. That table is bounded by
its parameters and goes to each task; a text's score for a language is the sum over its trigrams, by numpy over code
points. So every language of the labels can be found, and a text of any script has a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 20_000


@dataclass
class Profiles:
    """languages in code-point order; sorted trigram codes; log-likelihoods by trigram (and of any other) and language."""

    languages: list[str]
    grams: np.ndarray
    scores: np.ndarray
    other: np.ndarray


def _codes(text: str) -> np.ndarray:
    """A number for each run of three characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else np.zeros(0, np.int64)


def counts(df: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """(lang, gram, n): trigrams of the labelled texts; counted a batch at a time before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, []).append(_codes(t))
            for lang, codes in found.items():
                grams, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    rows = df.select(F.col(label).alias("lang"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")).where("lang IS NOT NULL")
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", label: str = "lang", most: int = MOST) -> Profiles:
    """Profiles of the languages that the labels name; rows without a label or text teach nothing.

    A trigram's likelihood in a language is (its count + 1) / (all counts + the number of trigrams of the model + 1).
    """
    table = counts(df, text, label).persist()
    try:
        totals = {r["lang"]: r["n"] for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        best = table.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(most)
        rows = table.join(F.broadcast(best.select("gram")), "gram").collect()
    finally:
        table.unpersist()
    languages = sorted(totals, key=lambda s: s.encode())
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    n = np.zeros((len(grams), len(languages)))
    for r in rows:
        n[np.searchsorted(grams, r["gram"]), languages.index(r["lang"])] = r["n"]
    whole = np.array([totals[x] for x in languages], float) + len(grams) + 1
    return Profiles(languages, grams, np.log((n + 1) / whole), np.log(1 / whole))


def detect(text: Column, profiles: Profiles) -> Column:
    """The language of each whole text, of equals the first by name; null for texts of fewer than three characters and
    without profiles."""

    @F.arrow_udf("string")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = profiles
        for b in batches:
            out = []
            for t in b:
                codes = _codes(t.as_py() or "")
                if not len(codes) or not p.languages:
                    out.append(None)
                    continue
                grams, n = np.unique(codes, return_counts=True)
                at = np.minimum(np.searchsorted(p.grams, grams), len(p.grams) - 1)
                known = p.grams[at] == grams
                score = n[known] @ p.scores[at[known]] + n[~known].sum() * p.other
                out.append(p.languages[int(score.argmax())])
            yield pa.array(out, pa.string())

    return find(F.lower(F.coalesce(text, F.lit(""))))


def accuracy(df: DataFrame, profiles: Profiles, text: str = "text", label: str = "lang") -> float:
    """The share of labelled texts whose language is found."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("want"), detect(F.col(text), profiles).alias("got"))
    return rows.agg(F.avg(F.col("want").eqNullSafe(F.col("got")).cast("int"))).first()[0] or 0.0
