"""Sections of filings and laws, by hand-made documents."""

from pyspark.sql import functions as F

from stratalens.operators import sections as S

BODY = "This is body text about many things. " * 5


def ids(found):
    return [s["section_id"] for s in found]


def test_positions_in_markup_come_first():
    html = f"<p>ITEM 1A. RISK FACTORS</p><p>{BODY}</p><p>{BODY}</p><table><tr><td>a</td><td>1</td></tr></table><p>ITEM 9A. Controls</p><p>short</p>"
    (found,) = S.filing_sections(html, "10-K")
    assert found["section_id"] == "item_1a" and found["text"].startswith("ITEM 1 A. RISK FACTORS This is body") and found["text"].endswith(" TABLE 1")  # brackets go, as all odd characters do
    assert found["word_count"] == len(found["text"].split()) and found["tables"][0]["rows"] == [["a", "1"]]
    # headers that leave nothing long enough leave nothing: nodes are looked at only if no header was found
    assert S.filing_sections("<p>ITEM 1A. RISK FACTORS</p><p>short</p>", "10-K") == []


def test_text_is_cleaned():
    (found,) = S.filing_sections(f"<p>ITEM 1A. RISK FACTORS</p><p>{BODY}one.Two  2025compared camelCase © end</p>", "10-K")
    assert found["text"].endswith("one. Two 2025 compared camel Case end")


def test_nodes_when_markup_has_no_header():
    html = f"<p>ITEM 8.</p><p>FINANCIAL STATEMENTS</p><p>{BODY}</p><p>Item 8. Financial again</p><p>{BODY}</p><p>Item 3. Legal</p>"
    found = S.filing_sections(html, "10-Q")
    assert ids(found) == ["item_8", "item_8"]  # a header over two nodes, one that comes twice, and one without a body
    assert ids(S.filing_sections("<p>nothing here</p>", "10-K")) == ["full_document"] and S.filing_sections("", "10-K") == []


def test_plain_text():
    found = S.plain_sections(f"ITEM 2 PROPERTIES {BODY} ITEM 2. PROPERTIES {BODY} ITEM 3 LEGAL no")
    assert ids(found) == ["item_2", "item_2"]
    assert ids(S.plain_sections("no header")) == ["full_document"] and S.plain_sections("  ") == []


def test_sections_of_a_table(spark):
    df = spark.createDataFrame([(1, f"<p>ITEM 2. PROPERTIES {BODY}</p>", "x"), (2, None, "y")], "id int, content string, error string")
    got = S.regex_sections(df.select("id", "content"), ["id"]).collect()
    assert [(r.id, r.pos, r.section.section_id, r.error) for r in got] == [(1, 0, "item_2", None)]  # cleaning parts the A of 1A from its number, so plain text has no item 1A


def test_python_and_column_cleaning_agree(spark):
    from stratalens.functions import text as T

    texts = ["a\n \n\nb\nc", "x.Y z!a 3b ١c", "camelCase  two   spaces ", "é© ß™ “q” 5€ a_b", "", "\n\n", "A.B.c\t\tD", "a\n\t b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_text(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == [S.clean(t) for t in texts]


def test_law_sections_nest():
    html = f"<div><h2>Outer</h2><section><h3>Inner</h3>{'x ' * 150}</section>{'y ' * 60}</div>"
    found = S.law_sections(html)
    assert [(s["section_id"], s["title"], s["word_count"]) for s in found] == [("section_0", "Outer", 210), ("section_1", "Inner", 150)]


def test_summary():
    long = "words " * 30
    assert S.law_summary(f"<p>Summary</p><div>An abstract of it: {long}</div>") == ("An abstract of it: " + long.strip())[:500]
    assert S.law_summary("<p>no such thing</p>") == "" == S.law_summary("")


def test_company_cascade(spark):
    from stratalens.functions import text as T

    cases = {
        "<title>Acme Corp - 10-K 2024</title>": "Acme Corp",
        "<title>x</title><meta name='company' content='Meta Co'>": "Meta Co",
        "<meta content='Site Inc' property='x'><meta property='og:site_name' content='Site Inc'>": "Site Inc",
        "<div class='a company b'>Div Ltd</div>": "Div Ltd",
        "<h1>FORM 10-K</h1><h1>Heading Plc</h1>": "Heading Plc",
        "COMPANY CONFORMED NAME:   Header Co\nx": "Header Co",
        "FILER: OTHER CO, LTD": "OTHER CO, LTD",
        "": "Unknown Company",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, h string").select("i", T.company_name(F.col("h")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == list(cases.values())
    ciks = {"CIK: 0000320193": "0000320193", "central index key 0000320194": "0000320194", "<meta name='cik' content='1234567890'>": "1234567890", "C.I.K. 0000320195": "0000320195", "id 0000320196 is the cik": "0000320196", "tel 0000320197": "", "1234567891 cik": ""}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(ciks)], "i int, h string").select("i", T.cik(F.col("h")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == list(ciks.values())


def test_text_sections_are_those_of_the_parser(spark):
    """Column expressions against the parser's own walk, on texts of headers, near headers and filling."""
    import random

    r = random.Random(10)
    heads = ["ITEM 1A. RISK FACTORS", "Item 1 : Business", "item 7A-quantitative", "ITEM\n7. Management", "ITEM 7 MANAGEMENTA", "Item 8 financial", "ITEM 2. PROPERTIES", "Item 11 Business", "ITEM 3", "Item 6.selected", "MANAGEMENT", "ITEM"]
    filling = lambda: " ".join(r.choice(["word", "Of,", "é", "1A", " ", "\n", "risk"]) for _ in range(r.choice([0, 3, 40, 120])))
    texts = ["".join(r.choice([f"{r.choice(heads)}{r.choice([' ', chr(10)])}", filling()]) for _ in range(r.randint(0, 9))) for _ in range(200)]
    texts += ["ITEM 7 MANAGEMENT", "ITEM 7 MANAGEMENT" + "ITEM 8 FINANCIAL " + "x y " * 60, "ITEM 7 MANAGEMENT " + "z " * 90, None, "", " \n\t", "x" * 50_000 + " ITEM 2 PROPERTIES " + "y " * 50_000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, section_id string")
    got = {}
    for x in S.text_sections(rows.select("id", "text"), ["id"]).orderBy("id", "pos").collect():
        got.setdefault(x.id, []).append((x.pos, x.section_id, x.title, x.text, x.word_count, x.char_count))
    want = {i: [(k, s["section_id"], s["title"], s["text"], s["word_count"], s["char_count"]) for k, s in enumerate(S.plain_sections(t or ""))] for i, t in enumerate(texts)}
    assert got == {i: v for i, v in want.items() if v}
    assert {x[1] for v in got.values() for x in v} >= {"item_1a", "item_1", "item_7a", "item_7", "item_8", "item_2", "item_6", "full_document"}
