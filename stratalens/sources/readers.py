"""Sources: files of every kind as DataFrames. Paths may be in any store that Spark reads."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import text as T


def files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, content, modified): whole text files below path, bytes that are no UTF-8 left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    valid = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return reader.load(path).select("path", valid.alias("content"), F.col("modificationTime").alias("modified"))


def not_utf8(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files below path that are not UTF-8. Files are read line by line, in splits; lines keep their bytes, and no
    character of several bytes holds a line feed, so a file is UTF-8 if its lines are."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    bad = lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("path")).distinct()
    return sorted(_plain(r["path"]) for r in bad.collect())


def _plain(address: str) -> str:
    """A file's address without escapes, and with one slash where no host is named."""
    return re.sub(r"^(\w+):///+", r"\1:/", unquote(address))


def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with a header, all columns text, names in lower case with underscores. Each file is UTF-8 if its bytes
    are, else ISO-8859-1. Files of one encoding share a header; columns that only one encoding's files have are null
    in the others."""
    bad = not_utf8(spark, path)
    every = [_plain(f) for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()]
    found = []
    for encoding, names in (("UTF-8", [f for f in every if f not in set(bad)]), ("ISO-8859-1", bad)):
        if names:
            df = spark.read.option("header", "true").option("encoding", encoding).option("multiLine", "true").option("quote", '"').option("escape", '"').csv(names)
            found.append(df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns]))
    if not found:
        raise FileNotFoundError(f"no files in {path}")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)


def companies_from_csv(df: DataFrame, name: str) -> DataFrame:
    """(ticker, company, sector, metrics) of index compositions and performance tables; no rows of other tables.
    Columns that are missing give '' or 0."""
    kind = T.csv_kind(name, df.columns)
    has = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    names = {"composition": ["weight", "price"], "performance": ["market_cap", "revenue", "net_income", "eps", "fcf"]}.get(kind, [])
    metrics = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[T.safe_float(has(n)) for n in names])) if names else F.create_map().cast("map<string,double>")
    blank = lambda c: F.coalesce(c, F.lit(""))
    out = df.select(blank(has("symbol")).alias("ticker"), blank(has("company") if kind == "composition" else has("company_name")).alias("company"), blank(has("sector")).alias("sector"), metrics.alias("metrics"))
    return out if names else out.limit(0)


def csv_chunks(companies: DataFrame) -> DataFrame:
    """One text a company: its names and its metrics."""
    metrics = F.array_join(F.transform(F.array_sort(F.map_entries("metrics")), lambda m: F.concat(m.key, F.lit(": "), m.value.cast("string"))), " ")
    return companies.withColumn("text", F.concat_ws(" ", "ticker", "company", metrics))


def tickers(df: DataFrame) -> DataFrame:
    """Distinct tickers of the first of the columns Symbol, Ticker, symbol, ticker: trimmed, upper case, commas as
    points; empty ones and those with spaces go."""
    column = next(c for c in ("Symbol", "Ticker", "symbol", "ticker") if c in df.columns)
    t = F.replace(F.upper(F.trim(F.col(column))), F.lit(","), F.lit("."))
    return df.select(t.alias("ticker")).where("ticker != '' AND NOT contains(ticker, ' ')").distinct()


def tickers_of_names(paths: DataFrame) -> DataFrame:
    stem = F.get(F.split(T.base_name(F.col("path")), "[_.]"), 0)
    return paths.select(stem.alias("ticker")).where("length(ticker) BETWEEN 1 AND 5").distinct()


def raw_filings(paths: DataFrame) -> DataFrame:
    """Raw filings among paths: below input/filings/<ticker>/, html or txt, the ticker and a form in the name; names descending."""
    name = F.lower(T.base_name(F.col("path")))
    ticker = F.regexp_extract("path", r"input/filings/([^/]+)/", 1)
    good = (ticker != "") & name.rlike(r"\.(html|txt)$") & F.contains(name, F.lower(ticker)) & name.rlike("10-k|10-q|8-k|10k|10q|8k")
    return paths.where(good).select(ticker.alias("ticker"), "path").orderBy("ticker", F.desc("path"))


def _substrings(text: Column, n: int) -> Column:
    """All substrings of n characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def parsed_filings(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parsed filings of tickers: files below parsed/ whose stem holds the ticker, else those in parsed/filings/<ticker>/."""
    name = T.base_name(F.col("path"))
    flat = paths.where(F.col("path").rlike(r"(^|/)parsed/[^/]+\.json$")).withColumn("_n", name)
    # every substring that could be a ticker meets tickers by equality: names are short, tickers have few letters
    lengths = [r["n"] for r in wanted.select(F.length("ticker").alias("n")).distinct().collect()]
    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *[_substrings(F.col("_n"), n) for n in lengths]))
    found = flat.select("path", F.explode(pieces).alias("ticker")).join(wanted, "ticker", "left_semi").select("ticker", "path")
    nested = paths.withColumn("ticker", F.regexp_extract("path", r"parsed/filings/([^/]+)/", 1)).where("ticker != ''").join(wanted, "ticker", "left_semi").select("ticker", "path")
    return found.unionByName(nested.join(found.select("ticker").distinct(), "ticker", "left_anti"))


def parsed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed documents; those that are no JSON objects go."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    return df.where("_corrupt IS NULL").drop("_corrupt")


def company_chunks(chunks: DataFrame, ticker: str, section: str | None = None) -> DataFrame:
    rows = chunks.where(F.col("ticker") == ticker)
    return (rows.where(F.col("section_type") == section) if section else rows).orderBy(F.desc_nulls_first("filing_date"), "section_type", "sentence_idx")


def markets(df: DataFrame, tags: list[str] = (), active: bool | None = None, most: int | None = None) -> DataFrame:
    """Prediction markets by tags and activity, in order of slug."""
    out = df.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else df
    out = out if active is None else out.where(F.col("active") == active)
    return out.orderBy("slug").limit(most) if most else out


def at_most(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in a stated order, or all: what max_files and max_tickers ask for."""
    return df.orderBy(*order).limit(n) if n else df


def listed_tickers(spark: SparkSession, text: str, most: int | None = None) -> DataFrame:
    """Tickers of a comma-separated list, in its order; blanks and repeats go."""
    given = list(dict.fromkeys(t.strip().upper() for t in text.split(",") if t.strip()))
    return spark.createDataFrame([(t,) for t in (given[:most] if most else given)], "ticker string")


def downloads(paths: DataFrame) -> DataFrame:
    """(filing_type, files) of downloaded filings, by their names."""
    return paths.groupBy(T.filing_type_of(F.col("path")).alias("filing_type")).agg(F.count("*").alias("files"))
