from pyspark.sql import functions as F

from stratalens.operators import models, service
from stratalens.plans import pipeline
from test_operators import FILING


def _chunks(spark):
    rows = [(f"c{i}", t, "Co", k, "10-K", "2024-01-01", i, x) for i, (t, k, x) in enumerate([("A", "risk_factors", "tariff on imports from China"), ("A", "business", "we sell phones"), ("B", "other", "bread and butter"), ("B", "other", "tariff on bread")])]
    return spark.createDataFrame(rows, "id string, ticker string, company_name string, section_type string, filing_type string, filing_date string, chunk_index int, text string").withColumn("filing_date", F.to_date("filing_date")).withColumn("embedding", models.embed(F.col("text")))


def test_service(spark):
    c = _chunks(spark)
    assert [r.ticker for r in service.companies(c).collect()] == ["A", "B"]
    assert service.company_filings(c, "A").first().chunks == 2
    assert [r.id for r in service.find(c, "tariff on imports from China", k=2, least=0.3).collect()] == ["c0", "c3"]
    data = spark.createDataFrame([("A", 0.5, 0.2, 0.0), ("B", 0.5, 0.2, 0.0)], "ticker string, revenue_exposed double, margin_sensitivity double, supply_dependency double")
    r = service.analyze(c, data, "tariff on imports from China", "2024-12-31", least=0.3).collect()
    assert len(r) == 1 and r[0].ticker == "A" and r[0].contributors[0].id == "c0" and 0 < r[0].raw <= 1
    nodes, edges = service.populate(c)
    assert ("A", "China") in {(e.source, e.target) for e in edges.collect()} and nodes.where("label = 'Company'").count() == 1
    assert {r.ticker for r in service.relevant_chunks(c).collect()} == {"A", "B"}


def test_replies(spark):
    d = spark.createDataFrame([('{"countries": ["China"]}',), ("no json",), (None,)], "r string")
    assert [r[0].countries for r in d.select(models.parse_extracted(F.col("r"))).collect()] == [["China"], [], []]
    d = spark.createDataFrame([('{"action": "BUY", "confidence": 0.5}',), ('{"action": "panic"}',)], "r string")
    assert [r[0].action for r in d.select(models.parse_advice(F.col("r"))).collect()] == ["buy", "neutral"]


def test_pipeline(spark, tmp_path):
    source = tmp_path / "input" / "filings" / "AAPL"
    source.mkdir(parents=True)
    (source / "2024-09-30-10k-AAPL.html").write_text(FILING)
    (tmp_path / "input" / "directive_x.html").write_text("<title>DIRECTIVE (EU) 2024/1</title><section>" + "words " * 80 + "</section>")
    config = pipeline.Config(str(tmp_path / "input"), str(tmp_path / "out"))
    assert pipeline.run(spark, config) == {"parse": "success", "aggregate": "success", "embeddings": "success"}
    got = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert {r.section_type for r in got.select("section_type").distinct().collect()} == {"business", "risk_factors"}
    assert spark.read.parquet(str(tmp_path / "out" / "legislation")).first().identifier == "2024/1"
    assert pipeline.run(spark, pipeline.Config(str(tmp_path / "input"), "x", dry_run=True))["parse"] == "planned"


def test_complete_ticker(spark):
    paths = spark.createDataFrame([(f"input/filings/{t}/2024-{f}.html",) for t, f in (("B", "10k"), ("B", "10q"), ("B", "8k"), ("A", "10k"))], "path string")
    assert service.complete_ticker(paths).first().ticker == "B"
