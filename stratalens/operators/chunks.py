"""Chunks: by section, by sentences, by characters, by words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T


def group_of(i: Column, n: Column, size: int) -> Column:
    """The group of sentence i of n: size sentences each; a tail shorter than half of size joins the group before."""
    tail = n % size
    joins = (tail > 0) & (tail * 2 < size) & (n > size)
    return F.when(joins, F.least(F.floor(i / size), F.floor(n / size) - 1)).otherwise(F.floor(i / size)).cast("int")


def sentence_chunks(sections: DataFrame, key: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """key, chunk_index, total_chunks, sentence_idx, sentences_in_chunk, total_sentences, chunk_text.

    Built within the row from the array of its sentences: no shuffle, and a long section is one row throughout.
    """
    s = sections.select(*key, T.sentences(F.col(text)).alias("_s")).where(F.size("_s") > 0)
    n = F.size("_s")
    tail = n % size
    count = F.ceil(n / size).cast("int") - F.when((tail > 0) & (tail * 2 < size) & (n > size), 1).otherwise(0)
    s = s.withColumn("_count", count)
    rows = s.select(*key, "_s", "_count", F.posexplode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("chunk_index", "_g"))
    start = F.col("chunk_index") * size
    length = F.when(F.col("chunk_index") == F.col("_count") - 1, n - start).otherwise(size)
    return rows.select(*key, "chunk_index", F.col("_count").alias("total_chunks"), start.alias("sentence_idx"), length.alias("sentences_in_chunk"), n.alias("total_sentences"), F.array_join(F.slice("_s", start + 1, length), " ").alias("chunk_text"))


def section_chunks(sections: DataFrame, group: str = "ticker", order: list[str] = ("section_type", "pos")) -> DataFrame:
    """One chunk a section, numbered within its company."""
    w = Window.partitionBy(group).orderBy(*order)
    return sections.withColumn("chunk_index", F.row_number().over(w) - 1).withColumn("total_chunks", F.count("*").over(Window.partitionBy(group)))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most size characters: cut at the coarsest separator that occurs, finer ones within longer parts;
    neighbours share up to overlap characters of whole parts."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    held: list[str] = []

    def width(ps: list[str]) -> int:
        return sum(map(len, ps)) + len(sep) * max(0, len(ps) - 1)

    def flush() -> None:
        joined = sep.join(held).strip()
        if joined:
            out.append(joined)

    for part in parts:
        if len(part) > size and finer:
            flush()
            held.clear()
            out += split_recursively(part, size, overlap, finer)
            continue
        if held and width([*held, part]) > size:
            flush()
            while held and (width(held) > overlap or width([*held, part]) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def pack_words(text: str, words: int) -> list[str]:
    """Whole sentences, in order, as many as fit in so many words; a longer sentence stands alone."""
    import re

    out, held, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        k = len(s.split())
        if held and n + k > words:
            out.append(" ".join(held))
            held, n = [], 0
        if s:
            held.append(s)
            n += k
    return out + ([" ".join(held)] if held else [])


def split_chunks(df: DataFrame, key: list[str], text: str = "text", size: int = 400, overlap: int = 50, unit: str = "chars") -> DataFrame:
    """key, chunk_index, total_chunks, chunk_text by the recursive splitter (unit chars) or by packed sentences
    (unit words). Arrow batches; each text is cut on its own."""
    src = df.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cut = (lambda t: split_recursively(t, size, overlap)) if unit == "chars" else (lambda t: pack_words(t, size))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces = b.pop("_text").map(cut)
            b = b.assign(chunk_text=pieces, total_chunks=pieces.map(len))[pieces.map(len) > 0].explode("chunk_text")
            b["chunk_index"] = b.groupby(level=0).cumcount()
            yield b[[*key, "chunk_index", "total_chunks", "chunk_text"]]

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "_text"], "chunk_index int, total_chunks int, chunk_text string"])
    return src.mapInPandas(split, schema)


def chunk_id(ticker: Column, section: Column, date: Column, form: Column, index: Column) -> Column:
    """Form and date are part of the id, so that filings of a company do not collide."""
    return F.concat_ws("_", ticker, form, date.cast("string"), section, index.cast("string"))
