import datetime
import math

import pytest
from pyspark.sql import functions as F

from stratalens.functions import scoring as S
from stratalens.operators import aggregate as A
from stratalens.operators import chunks as C
from stratalens.operators import graph as G
from stratalens.operators import knowledge as K
from stratalens.operators import search
from stratalens.operators import sections as X
from stratalens.sources import readers, sinks
from stratalens.streaming import streams


def test_scores_match_a_plain_computation(spark):
    day = datetime.date(2024, 12, 31)
    rows = [("A", 0.9, "risk_factors", day, "x" * 4000), ("A", 0.7, "business", None, ""), ("A", 0.75, "Other", day + datetime.timedelta(9), "y" * 40), ("B", 0.1, "other", day, "z")]
    m = spark.createDataFrame(rows, "ticker string, similarity double, section_type string, filing_date date, text string")
    c = spark.createDataFrame([("A", 0.5, None, None), ("B", 1.0, 1.0, 1.0), ("C", 0.0, 0.0, 0.0)], "ticker string, revenue_exposed double, margin_sensitivity double, supply_dependency double")
    got = {r.ticker: r for r in search.company_scores(search.exposures(m, "2024-12-31"), c, 0.75, 0.7).collect()}
    w = [1.0, 0.6 * 0.5 * 0.5, 0.5 * 0.1]
    raw = (0.9 * w[0] + 0.7 * w[1] + 0.75 * w[2]) / (sum(w) + 1e-12)
    assert got["A"].raw == pytest.approx(raw) and got["A"].sensitivity == pytest.approx(0.36)
    assert got["A"].expected == pytest.approx(raw * 0.36 * 0.75) and got["A"].risk_level == "medium"
    assert (got["B"].raw, got["B"].risk_level, got["C"].raw) == (0.0, "low", 0.0)


@pytest.mark.parametrize(("score", "level"), [(0.75, "critical"), (0.7499, "high"), (0.5, "high"), (0.2, "medium"), (0.1999, "low"), (0.0, "low")])
def test_risk_bands(spark, score, level):
    assert spark.range(1).select(S.risk_class(F.lit(score))).first()[0] == level


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in d.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / math.sqrt(2)), 0.0]


def test_revenue_exposed(spark):
    m = F.create_map(F.lit("China"), F.lit(30.0), F.lit("US"), F.lit(70.0))
    none = F.array().cast("array<string>")
    f = lambda *a: spark.range(1).select(S.revenue_exposed(*a)).first()[0]
    assert f(m, F.array(F.lit("China")), none) == pytest.approx(0.3)
    assert f(m, F.array(F.lit("Greater China")), none) == 0.0
    assert f(F.lit(None).cast("map<string,double>"), none, F.array(F.lit("Taiwan"))) == 0.4
    assert f(F.lit(None).cast("map<string,double>"), none, none) == 0.2


@pytest.mark.parametrize("n", range(1, 14))
def test_sentence_chunks_cover_each_sentence_once(spark, n):
    text = " ".join(f"Sentence {i} ends." for i in range(n))
    rows = C.sentence_chunks(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).orderBy("chunk_index").collect()
    assert " ".join(r.chunk_text for r in rows) == text and sum(r.sentences_in_chunk for r in rows) == n
    assert all(r.sentences_in_chunk >= 2 for r in rows) or n == 1


def test_splitters():
    text = ("alpha beta gamma. " * 60 + "\n\n") * 2
    pieces = C.split_recursively(text, 200, 40)
    assert all(len(p) <= 200 for p in pieces) and "gamma" in pieces[-1]
    assert C.split_recursively("", 10, 2) == [] and C.split_recursively("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert [len(p.split()) for p in C.pack_words("One two. Three four. Five.", 4)] == [4, 1]


def _filings(spark):
    def f(form, day, name, sid="item_1", title=""):
        return ("T", form, day, name, [(sid, title, f"text of {name}")])

    rows = [f("10-K", "2024-01-01", "k2"), f("10-K", "2023-01-01", "k1"), f("10-Q", "2024-02-01", "q1", "item_1a"), f("10-Q", "2024-03-01", "q2", "item_2"), *[f("8-K", f"2024-0{i}-01", f"e{i}") for i in range(1, 7)]]
    return spark.createDataFrame(rows, "ticker string, filing_type string, filing_date string, source_file string, sections array<struct<section_id: string, title: string, text: string>>")


def test_merge_sections(spark):
    got = sorted((r.section_type, r.source_file) for r in A.merge_sections(_filings(spark)).collect())
    assert got == sorted([("business", "k2"), ("risk_factors", "q1"), ("other", "q2"), *[("significant_events", f"e{i}") for i in range(2, 7)]])


def test_company_defaults(spark):
    view = A.company_view(_filings(spark).withColumn("company", F.lit("Name")))
    rows = {r.ticker: r for r in A.with_defaults(spark.createDataFrame([("T",), ("U",)], "ticker string"), view).collect()}
    assert (rows["T"].n_filings, rows["T"].company, rows["U"].n_filings, rows["U"].sources) == (10, "Name", 0, [])


def test_reachable_with_cycle_and_parallel_edges(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "x")], "source string, target string, type string")
    got = {(r.node, r.hops) for r in G.reachable(e, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert got == {("b", 1), ("c", 1), ("d", 2)}


def test_graph_and_sinks(spark, tmp_path):
    s = spark.createDataFrame([("T", 0, "Title O'Neil", "We manufacture goods in china and Operate plants in Germany")], "ticker string, pos int, title string, text string")
    e = A.entities(s.withColumn("title", F.lit("Risk")))
    nodes, edges = G.graph(spark.createDataFrame([("T", "Co")], "ticker string, company string"), e, s)
    kinds = {(r.target, r.type) for r in edges.collect()}
    assert {("China", "OPERATES_IN"), ("Germany", "OPERATES_IN"), ("china", "MANUFACTURES_IN")} <= kinds
    for form in ("json", "csv", "cypher"):
        assert sinks.save_graph(nodes, edges, str(tmp_path / form), form)
    assert not sinks.save_graph(nodes, edges, str(tmp_path / "no"), "xlsx")
    assert "CREATE (n:Company {id: 'T'" in "".join(r.value for r in spark.read.text(str(tmp_path / "cypher")).collect())


def test_knowledge(spark):
    k = spark.createDataFrame([("T", None, "Tech", ["EU"], ["x"], [], [], ["a"])], "ticker string, company string, sector string, regions array<string>, operations array<string>, risk_types array<string>, keywords array<string>, sources array<string>")
    n = spark.createDataFrame([("T", "Co", "Other", ["Asia"], [], [], [], ["b"])], k.schema)
    r = K.merge(k, n).first()
    assert (r.company, r.sector, r.regions, r.sources) == ("Co", "Tech", ["Asia", "EU"], ["a", "b"])
    assert K.search(K.merge(k, n), region="EU", sector="tech").count() == 1
    assert K.context(spark.createDataFrame([("zz",)], "ticker string"), k).first().regions == []


FILING = "<html><head><title>Apple Inc. - 10-K</title></head><body><p>CIK: 0000320193</p><h2>Item 1. &#160;Business</h2><p>" + "We make phones. " * 8 + "</p><h2>Item 1A. Risk Factors</h2><p>" + "Risks abound. " * 8 + "</p><table><tr><td>a</td><td>b</td></tr></table></body></html>"


def test_filing(spark):
    files = spark.createDataFrame([("2024-09-30-10k-AAPL.html", FILING), ("2024-01-01-10k-EMPTY.html", "<html></html>"), ("2024-01-01-10k-TEST.html", "<p>Item 1A. Risk Factors<b>" + "open " * 30), ("2024-01-01-10k-NONE.html", None)], "path string, content string")
    rows = X.filings(files).collect()
    a = [r for r in rows if r.ticker == "AAPL"]
    assert [r.section.section_id for r in a] == ["item_1", "item_1a"] and a[0].company == "Apple Inc." and a[0].cik == "0000320193" and a[0].fiscal_year == 2024
    assert a[1].section.tables[0].rows == [["a", "b"]]
    assert any(r.ticker == "TEST" and r.section.section_id == "item_1a" for r in rows) and all(r.error is None for r in rows)


def test_legislation(spark):
    html = "<html><title>REGULATION (EU) 2024/1689 on things</title><body>" + "".join(f"<section><h2>Part {i}</h2><p>{'word ' * 60}</p></section>" for i in range(3)) + "</body></html>"
    xml = "  <?xml version='1.0'?><bill><form><legis-num>H.R. 3301</legis-num></form><section><text>" + "law " * 40 + "</text></section></bill>"
    files = spark.createDataFrame([("directives/REGULATION_EU_1.html", html), ("H.R.3301-x.xml", xml), ("directives/bad.xml", "<a><b>" + "w " * 200)], "path string, content string")
    rows = X.legislation(files).collect()
    eu = [r for r in rows if r.identifier == "2024/1689"]
    assert len(eu) == 3 and eu[0].jurisdiction == "EU" and eu[0].title == "Part 0" and eu[0].language == "en"
    us = [r for r in rows if r.path == "H.R.3301-x.xml"]
    assert us[0].jurisdiction == "US" and us[0].document_type == "xml_legislation" and us[0].title == "text"


def test_csv(spark, tmp_path):
    (tmp_path / "2024-01-01_composition_x.csv").write_text('#,Company,Symbol,Weight,Price\n1,"A & B, Inc",BRK.B,"0,0765","181,99"\n')
    (tmp_path / "latin.csv").write_bytes("Symbol,Company Name,Market Cap,Revenue\nX,Société,1,2\n".encode("latin-1"))
    (tmp_path / "2024_composition_empty.csv").write_text("#,Company,Symbol,Weight,Price\n")
    r = readers.companies_from_csv(readers.csv(spark, str(tmp_path / "2024-01-01_composition_x.csv")), "2024-01-01_composition_x.csv").first()
    assert (r.ticker, r.company, r.metrics) == ("BRK.B", "A & B, Inc", {"weight": 0.0765, "price": 181.99})
    r = readers.companies_from_csv(readers.csv(spark, str(tmp_path / "latin.csv")), "latin.csv").first()
    assert (r.company, r.metrics["market_cap"], r.metrics["eps"]) == ("Société", 1.0, 0.0)
    assert readers.companies_from_csv(readers.csv(spark, str(tmp_path / "2024_composition_empty.csv")), "composition").count() == 0
    assert readers.companies_from_csv(spark.createDataFrame([("x",)], "other string"), "other.csv").count() == 0


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.html").write_bytes(b"caf\xe9 x")
    assert readers.files(spark, str(tmp_path / "in"), "*.html").first().content == "caf x"
    seen = []
    q = streams.on_arrival(streams.arriving_files(spark, str(tmp_path / "in"), "*.html"), lambda df, i: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination()
    streams.on_arrival(streams.arriving_files(spark, str(tmp_path / "in"), "*.html"), lambda df, i: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 1


def test_event_stream_equals_batch(spark, sf, tmp_path):
    import shutil

    (tmp_path / "ev").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "ev" / "e.parquet")
    q = streams.windowed(streams.event_stream(spark, str(tmp_path / "ev")), late="40 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = streams.windowed(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("w").count() == batch.count()


def test_checkpoint(spark):
    status = spark.createDataFrame([("A", "failed", 1), ("A", "processed", 2), ("B", "processed", 1), ("B", "failed", 2)], "ticker string, status string, at int")
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    assert sorted(r.ticker for r in sinks.open_tickers(wanted, status).collect()) == ["B", "C"]
