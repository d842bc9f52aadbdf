"""Documents to chunks, the knowledge table's life, sinks, and runs that meet failures."""

import json

import pytest
from pyspark.sql import functions as F

from stratalens.operators import documents, impact, knowledge
from stratalens.plans import pipeline
from stratalens.sources import readers, sinks

KNOWN = "ticker string, company string, sector string, regions array<string>, operations array<string>, risk_types array<string>"


def test_process_documents(spark):
    rows = [
        ("d1", "html_filing", "A", "Risk Factors", "<p>Tariff on imports.</p>  Supplier in <b>China</b>", None, None, None),
        ("d2", "html_legislation", None, "Article 1", "Rules on chips made in Japan", "EU", "regulation", "2024/1"),
        ("d3", "other", None, None, None, None, None, None),
    ]
    s = spark.createDataFrame(rows, "id string, document_type string, ticker string, title string, text string, jurisdiction string, type string, identifier string")
    plain = {r.id: (r.section_title, r.chunk_text) for r in documents.process(s, ["id"]).collect()}
    assert plain == {"d1": ("Risk Factors", "Tariff on imports. Supplier in China"), "d2": ("Article 1", "Rules on chips made in Japan")}
    k = spark.createDataFrame([("A", "Acme", "Tech", ["EU"], [], [])], KNOWN)
    got = {r.id: r.chunk_text for r in documents.process(s, ["id"], k, size=2000).collect()}
    assert got["d1"].startswith("[CONTEXT] COMPANY: Acme (A) SECTOR: Tech SECTION: Risk Factors REGIONS_MENTIONED: China, EU") and got["d1"].endswith("[CONTENT] Tariff on imports. Supplier in China")
    assert got["d2"].startswith("[CONTEXT] JURISDICTION: EU REGULATION_TYPE: regulation REGULATION_ID: 2024/1 AFFECTED_REGIONS: Japan")
    upper = documents.process(s.where("id = 'd2'"), ["id"], last=F.upper).first()
    assert upper.chunk_text == "RULES ON CHIPS MADE IN JAPAN"


def test_company_rows_and_json(spark):
    c = spark.createDataFrame([("A", "Acme", {"weight": 0.5, "price": 2.0}), ("B", None, {})], "ticker string, company string, metrics map<string,double>")
    assert [r.text for r in documents.company_rows(c).orderBy("ticker").collect()] == ["Company: Acme Ticker: A price: 2.0 weight: 0.5", "Company:  Ticker: B "]
    (one,) = documents.as_json(c.where("ticker = 'A'"), ["ticker"]).collect()
    assert one.ticker == "A" and json.loads(one.json) == {"company": "Acme", "metrics": {"weight": 0.5, "price": 2.0}}


def test_knowledge_table(spark, tmp_path):
    path = str(tmp_path / "knowledge")
    assert knowledge.load(spark, path).count() == 0
    row = lambda t, sector, regions, data: (t, None, sector, regions, [], [], [], ["s"], data)
    knowledge.save(spark.createDataFrame([row("A", "Tech", ["EU"], {"k": "old", "x": "1"})], knowledge.SCHEMA), path)
    new = spark.createDataFrame([row("A", "Energy", ["China"], {"k": "new"}), row("B", None, [], None)], knowledge.SCHEMA)
    got = {r.ticker: r for r in knowledge.refresh(knowledge.load(spark, path), new).collect()}
    assert got["A"].sector == "Tech" and got["A"].regions == ["China", "EU"] and got["A"].metadata == {"k": "new", "x": "1"} and got["B"].metadata == {}
    assert {r.ticker: r.sector for r in knowledge.refresh(knowledge.load(spark, path), new, overwrite=True).collect()}["A"] == "Energy"


def test_sinks_and_lists(spark, tmp_path):
    status = spark.createDataFrame([("A", "successful"), ("B", "failed"), ("C", "successful")], "ticker string, status string")
    assert sinks.summary(status).first().asDict() == {"total": 3, "successful": 2, "failed": 1, "skipped": 0, "success_rate": 66.7}
    assert sinks.summary(status.limit(0)).first().success_rate == 0
    sinks.results(status, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    sinks.companies(status, str(tmp_path / "c"))
    assert len(list((tmp_path / "c" / "ticker=A").glob("*.parquet"))) == 1
    assert [r.ticker for r in readers.listed_tickers(spark, " a,B ,,a, c", 2).collect()] == ["A", "B"]
    assert readers.listed_tickers(spark, "").count() == 0


def test_a_failing_stage_is_told(spark, tmp_path, monkeypatch):
    source = tmp_path / "input" / "filings" / "A"
    source.mkdir(parents=True)
    (source / "2024-09-30-10k-A.html").write_text("<p>ITEM 1A. RISK FACTORS " + "words " * 40 + "</p>")
    config = pipeline.Config(str(tmp_path / "input"), str(tmp_path / "out"))

    def broken(df, path):
        raise RuntimeError("no space")

    monkeypatch.setattr(sinks, "companies", broken)
    assert pipeline.run(spark, config) == {"parse": "success", "aggregate": "failed: RuntimeError", "embeddings": "skipped"}
    assert set(pipeline.run(spark, pipeline.Config(str(tmp_path / "none"), "x")).values()) == {"skipped"}


def test_explanations(spark):
    m = spark.createDataFrame(
        [(1, "A", 0.9, "risk_factors", "Risk", "10-K", "2024-12-01", "long " * 60, "3", "10"), (2, "A", 0.8, "business", "Business", "10-K", "2024-12-01", "short", None, None), (3, "A", 0.1, "other", "O", "10-K", "2024-12-01", "x", "bad", "7")],
        "id long, ticker string, similarity double, section_type string, section_title string, filing_type string, filing_date string, text string, sentence_idx string, total_sentences string",
    ).withColumn("filing_date", F.to_date("filing_date"))
    c = spark.createDataFrame([("A", "Acme", 1.0, 1.0, 1.0)], "ticker string, company string, revenue_exposed double, margin_sensitivity double, supply_dependency double")
    r = impact.analyze(m, c, "HR 1", "2024-12-31", 1.0, tickers=c.select("ticker").union(spark.createDataFrame([("Z",)], "ticker string"))).collect()
    a, z = sorted(r, key=lambda x: x.ticker)
    assert (z.risk_level, z.expected, z.total_matches) == ("unknown", 0.0, 0)
    assert a.total_matches == 2 and [x.id for x in a.matches] == [1, 2] and [x.sentence_position for x in a.matches] == ["4 of 10", "1"]
    lines = a.explanation.split("\n")
    assert lines[0] == f"IMPACT ASSESSMENT: {a.risk_level.upper()} RISK" and "Company: Acme (A)" in lines and "  1. Risk (similarity: 0.900)" in lines and "  - business: 1 matches, avg similarity 0.800" in lines
    assert any(x.endswith('..."') for x in lines) and a.details.statistics.section_breakdown == {"risk_factors": 1, "business": 1}
    assert a.details.summary == f"Risk Level: {a.risk_level.upper()}, Score: {a.expected:.3f}"
    with pytest.raises(Exception, match="ticker"):
        impact.analyze(m.drop("ticker"), c, "x", "2024-12-31").collect()
