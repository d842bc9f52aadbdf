"""Context headers of chunks and regulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import tags, vocab


def _line(name: str, value: Column) -> Column:
    """NAME: value, or null if there is none."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))


def _listed(values: Column, most: int = 0) -> Column:
    values = F.slice(values, 1, most) if most else values
    return F.array_join(values, ", ")


def kg_line(relations: Column, most: int = 5) -> Column:
    """Relations of a map<relation, targets>, at most so many targets each, with how many more there are."""
    kinds = ["OPERATES_IN", "MANUFACTURES_IN", "HAS_OPERATION", "SUPPLY_CHAIN_IN", "HAS_RISK_TYPE"]

    def part(kind: str) -> Column:
        t = F.try_element_at(relations, F.lit(kind))
        more = F.when(F.size(t) > most, F.concat(F.lit(" (+"), (F.size(t) - most).cast("string"), F.lit(" more)"))).otherwise("")
        return F.when(F.size(t) > 0, F.concat(F.lit(f"{kind}: "), _listed(t, most), more))

    return F.array_join(F.array_compact(F.array(*[part(k) for k in kinds])), "; ")


def relations(triples: DataFrame, by: str = "subject", order: str | None = None) -> DataFrame:
    """(by, relations): a map of each relation to its objects, in the triples' order (else by name). Triples without a
    relation or an object do not count."""
    known = triples.where("coalesce(relation, '') != '' AND coalesce(object, '') != ''")
    place = F.col(order) if order else F.lit(0)
    lists = known.groupBy(by, "relation").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "object"))).alias("o"))
    entry = F.struct("relation", F.transform("o", lambda x: x.object))
    return lists.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("relations"))


def section_header(text: Column, c: dict[str, Column]) -> Column:
    """[CONTEXT], a line for each thing known, [CONTENT], the text. c: columns by name; those missing are left out."""
    has = lambda n: c.get(n, F.lit(None).cast("string"))
    lists = lambda n: _listed(c[n]) if n in c else F.lit(None).cast("string")
    lines = [
        _line("COMPANY", F.concat(has("company"), F.lit(" ("), F.coalesce(has("ticker"), F.lit("")), F.lit(")"))), _line("SECTOR", has("sector")), _line("INDUSTRY", has("industry")),
        _line("SECTION", F.concat(F.upper(has("section_type")), F.lit(" - "), F.coalesce(has("title"), F.lit("")))), _line("FILING", F.concat(has("filing_type"), F.lit(" dated "), F.coalesce(has("filing_date"), F.lit("N/A")))),
        _line("COUNTRIES_MENTIONED", lists("countries")), _line("REGIONS_OPERATIONS", lists("regions")), _line("OPERATIONS", lists("operations")), _line("RISK_TYPES", lists("risk_types")),
        _line("KNOWLEDGE_GRAPH_RELATIONSHIPS", kg_line(c["relations"])) if "relations" in c else F.lit(None).cast("string"),
    ]
    return F.concat_ws("\n", F.lit("[CONTEXT]"), *lines, F.lit("[CONTENT]"), text)


def sentence_header(sentence: Column, before: Column, after: Column, c: dict[str, Column]) -> Column:
    """A short header (five countries, three of other lists), then the sentence between its neighbours."""
    lists = lambda n, k: _line({"countries": "COUNTRIES", "operations": "OPERATIONS", "risk_types": "RISKS"}[n], _listed(c[n], k)) if n in c else F.lit(None).cast("string")
    has = lambda n: c.get(n, F.lit(None).cast("string"))
    return F.concat_ws(
        "\n", F.lit("[CONTEXT]"), _line("COMPANY", has("company")), _line("SECTION", has("section_type")), lists("countries", 5), lists("operations", 3), lists("risk_types", 3),
        _line("KG", kg_line(c["relations"], 3)) if "relations" in c else F.lit(None).cast("string"), _line("[PREV_CONTEXT]", before), F.concat(F.lit("[TARGET_SENTENCE]: "), sentence), _line("[NEXT_CONTEXT]", after),
    )


def filing_chunks(chunks: DataFrame, knowledge: DataFrame) -> DataFrame:
    """chunks (ticker, section_title, text) with enriched_text: what is known of the company, united with what the
    raw text names. knowledge has a row a ticker; Spark broadcasts it if its size allows."""
    k = knowledge.select("ticker", "company", "sector", F.col("regions").alias("_r"), F.col("operations").alias("_o"), F.col("risk_types").alias("_k"))
    none = F.array().cast("array<string>")
    unite = lambda known, found: F.array_sort(F.array_union(F.coalesce(known, none), found))
    t, found = F.col("text"), lambda name: F.col(f"_found.{name}")
    named = tags.labels_of(t, {"regions": vocab.REGIONS, "operations": vocab.OPERATIONS, "risk_types": vocab.RISKS})
    header = F.concat_ws(
        "\n", F.lit("[CONTEXT]"), F.when(F.col("ticker") != "", F.concat(F.lit("COMPANY: "), F.coalesce("company", F.lit("")), F.lit(" ("), F.col("ticker"), F.lit(")"))), _line("SECTOR", F.col("sector")), _line("SECTION", F.col("section_title")),
        _line("REGIONS_MENTIONED", _listed(unite(F.col("_r"), found("regions")))), _line("OPERATIONS", _listed(unite(F.col("_o"), found("operations")))), _line("RISK_TYPES", _listed(unite(F.col("_k"), found("risk_types")))),
    )
    rows = chunks.withColumn("_found", named).join(k, "ticker", "left").withColumn("enriched_text", F.concat(header, F.lit("\n\n[CONTENT]\n"), t))
    return rows.drop("_found", "_r", "_o", "_k", "company", "sector")


def regulation_text(text: Column, jurisdiction: Column, kind: Column, identifier: Column) -> Column:
    named = tags.labels_of(text, {"regions": vocab.REGIONS, "areas": vocab.AREAS})
    lines = [_line("JURISDICTION", jurisdiction), _line("REGULATION_TYPE", kind), _line("REGULATION_ID", identifier), _line("AFFECTED_REGIONS", _listed(named["regions"])), _line("AFFECTED_AREAS", _listed(named["areas"]))]
    header = F.concat_ws("\n", *lines)
    return F.when(header == "", text).otherwise(F.concat(F.lit("[CONTEXT]\n"), header, F.lit("\n\n[CONTENT]\n"), text))
