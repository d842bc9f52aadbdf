"""Every query with a SQL twin gives the same rows as DuckDB."""

import math

import pytest

from stratalens.plans import registry

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, sf, name):
    assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(con.sql(registry.oracle_sql()[name]).df())


#: Sentences that begin or end with their own index (0, 1, 10), and white space of all kinds.
ODD_TEXTS = ["0 is first. At 1. Last 2", "Call 555-8230", "10.", "0", "One.\n\nTwo.\tThree.\fFour.\r\nFive.\x0bSix", "  A.  B!  c? D  ", "A.\u00a0B. É. ñ", " ", "", " ".join(f"S{i} has {i}." for i in range(25))]


@pytest.mark.parametrize("name", ["sentence_chunks", "sentence_split"])
def test_same_sentences_of_odd_texts(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate([*ODD_TEXTS, None])), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = registry.queries()[name](spark, str(tmp_path)), con.sql(registry.oracle_sql()[name])
    assert sorted([tuple(r) for r in got.select(want.columns).collect()], key=repr) == sorted(want.fetchall(), key=repr)


def test_the_others_are_their_parsers(spark, sf):
    """Queries that no SQL can express: each row against the parser, applied to the document by itself."""
    from stratalens.operators import chunks, sections

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    get = lambda name: registry.queries()[name](spark, sf).collect()
    assert {r.page_id: r.text for r in get("html_text")} == {p.page_id: sections.html_text(p.html or "") for p in pages}
    want = {(p.page_id, i): (s["section_id"], s["word_count"]) for p in pages for i, s in enumerate(sections.filing_sections(p.html or "", "10-K"))}
    assert {(r.page_id, r.pos): (r.section_id, r.word_count) for r in get("html_sections")} == want and len(want) >= len(pages) / 2
    want = {(f"directives/law_{p.page_id}.html", s["section_id"]): s["word_count"] for p in pages for s in sections.law_sections(p.html or "")}
    assert {(r.path, r.section_id): r.word_count for r in get("legislation_sections")} == want and want
    got = {(r.doc_id, r.chunk_index): (r.total_chunks, r.chunk_text) for r in get("recursive_chunks")}
    want = {d.doc_id: chunks.split_recursively(d.text or "", 400, 50) for d in docs}
    assert got == {(k, i): (len(v), x) for k, v in want.items() for i, x in enumerate(v)}
    laws = get("xml_sections")
    assert laws and all(r.error is None and r.section_id.startswith(("xml_section_", "section_", "main")) for r in laws)
    named = {"html_text", "html_sections", "legislation_sections", "recursive_chunks", "xml_sections"}
    assert set(registry.queries()) - set(registry.oracle_sql()) == named


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())
