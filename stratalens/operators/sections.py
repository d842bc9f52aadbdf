"""Documents to rows: SEC submissions, filing sections, legislation HTML and XML, tables.

Where a document's tree matters, a small parser of ours (on the standard library's tokenizer) runs inside an
Arrow-batched map; a document that cannot be parsed gives a row with its error and never fails the job.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from stratalens import schemas
from stratalens.functions import text as T
from stratalens.functions import vocab

BLOCK = {"p", "div", "section", "article", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "ul", "ol", "body", "title", "blockquote"}
SKIP = {"script", "style", "head", "noscript"}


def submissions(content: Column) -> Column:
    """The <DOCUMENT> blocks of a submission, or the whole text."""
    found = F.regexp_extract_all(content, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(content))


def main_document(blocks: Column) -> Column:
    """The only block; the first typed 10-K, 10-Q or 8-K with a <TEXT>; the longest <TEXT> with an item; the longest."""
    body = lambda d: F.regexp_extract(d, r"(?is)<TEXT>(.*?)</TEXT>", 1)
    typed = F.filter(blocks, lambda d: d.rlike(r"(?i)<TYPE>[^<\n]*(10-K|10-Q|8-K)") & (body(d) != ""))
    longest = lambda a: F.get(F.filter(a, lambda d: F.length(d) == F.array_max(F.transform(a, F.length))), 0)
    with_items = F.filter(F.transform(blocks, body), lambda t: t.rlike(r"(?i)ITEM\s+\d+[A-Z]?"))
    return F.when(F.size(blocks) == 1, F.get(blocks, 0)).otherwise(F.coalesce(body(F.get(typed, 0)), longest(with_items), longest(blocks)))


class _Nodes(HTMLParser):
    """Text nodes (of block elements) and tables, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, object]] = []
        self.held: list[str] = []
        self.skip = 0
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def _end_text(self) -> None:
        s = " ".join("".join(self.held).split())
        self.held.clear()
        if s:
            self.nodes.append(("text", s))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIP:
            self.skip += 1
        elif tag == "table":
            self._end_text()
            self.tables.append([])
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and tag in ("td", "th"):
            self.cell = []
        elif tag in BLOCK:
            self._end_text()

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cell is not None:
            if self.tables and self.tables[-1]:
                self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.tables:
            rows = [r for r in self.tables.pop() if r]
            self.nodes.append(("table", rows))
        elif tag in BLOCK:
            self._end_text()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.held if self.cell is None else self.cell).append(data)

    def done(self) -> list[tuple[str, object]]:
        self.close()
        self._end_text()
        return self.nodes


def html_nodes(html: str) -> list[tuple[str, object]]:
    parser = _Nodes()
    parser.feed(html)
    return parser.done()


def html_text(html: str) -> str:
    """All text of a document, tables' cells too."""
    return " ".join(v if kind == "text" else " ".join(" ".join(r) for r in v) for kind, v in html_nodes(html))


def header_hits(content: str, filing_type: str) -> list[tuple[int, str, str]]:
    """(position, section id, title) of a form's headers: the first hit of each id, in order of position."""
    hits: dict[str, tuple[int, str, str]] = {}
    for pattern, sid, title in vocab.SECTIONS.get(filing_type.upper(), vocab.SECTIONS[""]):
        if (m := re.search(pattern, content, re.IGNORECASE | re.MULTILINE)) and (sid not in hits or m.start() < hits[sid][0]):
            hits[sid] = (m.start(), sid, title)
    return sorted(hits.values())


_CLEANING = [(re.compile(pattern.replace("(?U)", "")), to.replace("$", "\\")) for pattern, to in vocab.CLEANING]


def clean(text: str) -> str:
    """What functions.text.clean_text() does, for text that a document's parser holds."""
    for pattern, to in _CLEANING:
        text = pattern.sub(to, text)
    return text


def _made(sid: str, title: str, body: str, tables: list[dict]) -> dict:
    return {"section_id": sid, "title": title, "text": body, "tables": tables, "word_count": len(body.split()), "char_count": len(body)}


def _section(sid: str, title: str, nodes: list[tuple[str, object]], least: int) -> dict | None:
    """The nodes' text, cleaned, with marks where tables stand, and the tables; None if it is shorter than least."""
    parts, tables, last = [], [], None
    for kind, value in nodes:
        if kind == "text" and value != last:
            parts.append(value)
            last = value
        elif kind == "table" and value:
            text = "\n".join(" | ".join(r) for r in value)
            tables.append({"rows": value, "row_count": len(value), "column_count": len(value[0]), "text": text})
            parts.append(f"[TABLE {len(tables)}]")
    body = clean(" ".join(parts))
    return _made(sid, title, body, tables) if len(body) >= least else None


def _all_hits(text: str, patterns: list[tuple[str, str, str]]) -> list[tuple[int, str, str]]:
    """(position, section id, title) of every hit, in order of position; of hits at one place in the patterns' order."""
    hits = [(m.start(), i) for i, (pattern, _, _) in enumerate(patterns) for m in re.finditer(pattern, text, re.IGNORECASE | re.MULTILINE)]
    return [(at, *patterns[i][1:]) for at, i in sorted(hits)]


def node_sections(nodes: list[tuple[str, object]]) -> list[dict]:
    """Sections between nodes in which a header begins, 100 characters or more; headers may run on into the next node,
    and one that comes twice gives two. None: all text as one."""
    full, starts, last = "", [], None
    for kind, value in nodes:
        starts.append(len(full))
        text = value if kind == "text" else "\n".join(" | ".join(r) for r in value)
        if text and text != last:
            full += text + "\n"
            last = text
    heads = [(bisect_right(starts, at) - 1, sid, title) for at, sid, title in _all_hits(full, vocab.FALLBACK_SECTIONS)]
    ends = [*[h[0] for h in heads[1:]], len(nodes)][: len(heads)]
    found = [_section(sid, title, nodes[a:b], 100) for (a, sid, title), b in zip(heads, ends, strict=True)]
    if found := [s for s in found if s]:
        return found
    whole = clean(" ".join(v for kind, v in nodes if kind == "text"))
    return [_made("full_document", "Full Document", whole, [])] if whole else []


def plain_sections(text: str) -> list[dict]:
    """Sections between all headers of plain text, cleaned, 100 characters or more; none: the whole text."""
    hits = _all_hits(text, vocab.PLAIN_SECTIONS)
    ends = [*[h[0] for h in hits[1:]], len(text)][: len(hits)]
    found = [_made(sid, title, body, []) for (at, sid, title), end in zip(hits, ends, strict=True) if len(body := clean(text[at:end])) >= 100]
    return found or ([_made("full_document", "Full Document", clean(text), [])] if text.strip() else [])


def filing_sections(content: str, filing_type: str) -> list[dict]:
    """Sections between the positions of the form's headers in the markup (50 characters or more). A document without
    any goes by its nodes, and one that cannot be parsed by its plain text. A header stays at the start of its text."""
    hits = header_hits(content, filing_type)
    if hits:
        ends = [*[h[0] for h in hits[1:]], len(content)][: len(hits)]
        found = [_section(sid, title, html_nodes(content[at:end]), 50) for (at, sid, title), end in zip(hits, ends, strict=True)]
        return [s for s in found if s]
    try:
        nodes = html_nodes(content)
    except Exception:  # markup of any kind may come
        return plain_sections(clean(re.sub("<[^>]+>", " ", content)))
    return node_sections(nodes)


FLUSH_CHARS = 4 << 20  # of results that a task holds


def _mapped(df: DataFrame, columns: list[str], keep: list[str], schema: str, parse: Callable[..., Iterable[dict]]) -> DataFrame:
    """Rows of parse(*columns): keep, the schema's columns, and error. Batches go out by the size of what they hold."""
    src = df.select(*keep, *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in columns])
    made = StructType.fromDDL(schema) if schema else StructType()
    out_schema = StructType([*src.schema.fields[: len(keep)], *made.fields, StructField("error", StringType())])
    arrow = to_arrow_schema(StructType([*made.fields, StructField("error", StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = [b.column(len(keep) + i) for i in range(len(columns))]
            rows: list[int] = []
            out: list[dict] = []
            held = 0

            def batch() -> pa.RecordBatch:
                taken = b.take(pa.array(rows, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([*taken.columns[: len(keep)], *[pa.array([r.get(f.name) for r in out], f.type) for f in arrow]], out_schema.names)  # noqa: B023

            for i in range(len(b)):
                values = [c[i].as_py() for c in sources]
                try:
                    found = list(parse(*values))
                except Exception as e:  # a document of any shape may come; it is reported in its row
                    found = [{"error": f"{type(e).__name__}: {e}"}]
                rows += [i] * len(found)
                out += found
                held += sum(map(len, values))
                if held > FLUSH_CHARS:
                    yield batch()
                    rows, out, held = [], [], 0
            yield batch()

    return src.mapInArrow(run, out_schema)


def sections(df: DataFrame, keep: list[str], content: str = "content", filing_type: str = "filing_type") -> DataFrame:
    """keep, pos, section (struct), error: one row a section."""

    def parse(text: str, form: str) -> Iterator[dict]:
        for i, s in enumerate(filing_sections(text, form)):
            yield {"pos": i, "section": s}

    return _mapped(df, [content, filing_type], keep, f"pos int, section {schemas.SECTION}", parse)


def regex_sections(df: DataFrame, keep: list[str], html: str = "content") -> DataFrame:
    """The plain-text way: keep, pos, section, error of tag-stripped text, one row a section."""
    plain = df.select(*keep, T.strip_tags(F.col(html)).alias("_plain"))
    return _mapped(plain, ["_plain"], keep, f"pos int, section {schemas.SECTION}", lambda text: [{"pos": i, "section": s} for i, s in enumerate(plain_sections(text))])


_ITEM = r"ITEM\s+"


def _any_header(after: str) -> str:
    """One pattern for all headers of plain text: what they all begin with stands first, so that a place where none
    begins is left at once. `after` takes the place of the character that some ask for after their words."""
    return _ITEM + "(?:" + "|".join(p.removeprefix(_ITEM).replace("[^A]", after) for p, *_ in vocab.PLAIN_SECTIONS) + ")"


def text_sections(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """plain_sections() of plain text, in Column expressions: keep, pos, section_id, title, text, word_count, char_count.

    A text is split right before every header, so each part begins with its own; the character after a header may begin
    the next one. What stands before the first header goes.
    Parts are cleaned and kept from 100 characters on; a text of which none is left is one section, a blank or null
    text has none.
    """
    headers = [(f"(?iU)^(?:{p.replace('[^A]', '(?!A)')})", sid, title) for p, sid, title in vocab.PLAIN_SECTIONS]
    every = _any_header("(?=[^A])")
    t = F.coalesce(F.col(text), F.lit(""))
    begins = t.rlike(f"(?iU)^(?:{every})")

    def named(part: Column, i: Column) -> Column:
        which = F
        for n, (pattern, *_) in enumerate(headers):
            which = which.when(part.rlike(pattern), F.lit(n))
        return F.struct(F.when((i > 0) | begins, which).alias("n"), T.clean_text(part).alias("text"))

    of = lambda k: F.array(*[F.lit(h[k]) for h in headers])
    made = lambda sid, title, body: F.struct(sid.alias("section_id"), title.alias("title"), body.alias("text"))
    parts = F.filter(F.transform(F.split(t, f"(?iU)(?={every})", -1), named), lambda x: x.n.isNotNull() & (F.length(x.text) >= 100))
    found = F.transform(parts, lambda x: made(F.get(of(1), x.n), F.get(of(2), x.n), x.text))
    # the whole text is cleaned only where no part is left
    whole = F.array(made(F.lit("full_document"), F.lit("Full Document"), T.clean_text(F.col("_t"))))
    rows = df.select(*keep, t.alias("_t"), found.alias("_found"))
    rows = rows.select(*keep, F.posexplode(F.when(F.size("_found") > 0, F.col("_found")).when(F.col("_t").rlike(r"(?U)\S"), whole)).alias("pos", "s"))
    return rows.select(*keep, "pos", "s.*", F.size(F.regexp_extract_all("s.text", F.lit(r"(?U)\S+"), F.lit(0))).alias("word_count"), F.length("s.text").alias("char_count"))


def filings(files: DataFrame) -> DataFrame:
    """files (path, content) to filings: names give ticker, form, date and year; contents company, CIK and sections."""
    main = main_document(submissions(F.coalesce("content", F.lit(""))))
    p = F.col("path")
    rows = files.select("path", main.alias("content"), F.lit("html_filing").alias("document_type"), T.ticker_of(p).alias("ticker"), T.company_name(F.col("content")).alias("company"), T.filing_type_of(p).alias("filing_type"), T.date_of(p).alias("filing_date"), T.cik(F.col("content")).alias("cik"))
    return sections(rows, ["path", "document_type", "ticker", "company", "filing_type", "filing_date", "cik"]).withColumn("fiscal_year", T.fiscal_year(F.col("filing_date")))


class _Law(HTMLParser):
    """section, article and div elements in document order, with their text and first heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.found: list[dict] = []
        self.heading: list[str] | None = None
        self.body: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIP:
            self.skip += 1
        elif tag in ("section", "article", "div"):
            element = {"from": len(self.body), "to": None, "title": None}
            self.found.append(element)
            self.open.append(element)
        elif tag in ("h1", "h2", "h3", "h4", "strong", "b"):
            self.heading = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("section", "article", "div") and self.open:
            self.open.pop()["to"] = len(self.body)
        elif tag in ("h1", "h2", "h3", "h4", "strong", "b") and self.heading is not None:
            title = " ".join("".join(self.heading).split())[:100]
            for element in self.open:
                element["title"] = element["title"] or title
            self.heading = None

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        self.body.append(data)
        if self.heading is not None:
            self.heading.append(data)


def law_sections(html: str, most: int = 10) -> list[dict]:
    """Of the first 20 section, article and div elements those of more than 200 characters (nested ones repeat
    text); at most 10; none: the body as main. Texts end at 5000 characters, words are counted in full."""
    parser = _Law()
    parser.feed(html)
    parser.close()
    out = []
    for i, element in enumerate(parser.found[:20]):
        text = "".join(parser.body[element["from"] : element["to"]]).strip()
        if len(text) > 200:
            out.append({"section_id": f"section_{i}", "title": element["title"] or f"Section {i + 1}", "text": text[:5000], "word_count": len(text.split())})
    body = "".join(parser.body).strip()
    return out[:most] or ([{"section_id": "main", "title": "Main", "text": body[:5000], "word_count": len(body.split())}] if body else [])


class _Parents(HTMLParser):
    """Pieces of text in document order, and for each word of SUMMARY_WORDS the element around the first piece with it."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[dict] = []
        self.first: dict[str, dict | None] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.VOID:
            self.open.append({"tag": tag, "from": len(self.pieces), "to": None})

    def handle_endtag(self, tag: str) -> None:
        if any(e["tag"] == tag for e in self.open):
            while (e := self.open.pop())["tag"] != tag:
                e["to"] = len(self.pieces)
            e["to"] = len(self.pieces)

    def handle_data(self, data: str) -> None:
        low = data.lower()
        for word in vocab.SUMMARY_WORDS:
            if word in low and word not in self.first:
                self.first[word] = self.open[-1] if self.open else None
        if data.strip():
            self.pieces.append(data.strip())


def law_summary(html: str) -> str:
    """The text (500 characters) of the element around the first mention of a summary, an abstract or an overview, the
    first of these that has more than 100 characters."""
    parser = _Parents()
    parser.feed(html)
    parser.close()
    for word in vocab.SUMMARY_WORDS:
        if element := parser.first.get(word):
            text = "".join(parser.pieces[element["from"] : element["to"]])
            if len(text) > 100:
                return text[:500]
    return ""


def summaries(df: DataFrame, keep: list[str], html: str = "content") -> DataFrame:
    """keep, summary, error of laws."""
    return _mapped(df, [html], keep, "summary string", lambda text: [{"summary": law_summary(text)}])


def xml_sections(xml: str, most: int = 10) -> list[dict]:
    """Elements with more than 100 characters of own text, by place in the tree; HTML rules if it is no XML."""
    try:
        root = ElementTree.fromstring(xml.strip())
    except ElementTree.ParseError:
        return law_sections(xml)
    out = []
    for i, element in enumerate(root.iter()):
        text = (element.text or "").strip()
        if len(text) > 100:
            out.append({"section_id": f"xml_section_{i}", "title": element.tag.rpartition("}")[2], "text": text[:5000], "word_count": len(text.split())})
    return out[:most]


def legislation(files: DataFrame) -> DataFrame:
    """files (path, content) to sections of legislation with identifier, type, jurisdiction, confidence, language."""
    c, p = F.col("content"), F.col("path")
    named = F.substring(F.trim(F.regexp_replace(T.first_match(c, vocab.LAW_TITLES), "<[^>]+>", "")), 1, 200)
    title = F.coalesce(F.nullif(named, F.lit("")), F.regexp_replace(T.base_name(p), r"\.(html|xml)", ""))
    where = T.jurisdiction(c, T.base_name(p))
    rows = files.select("path", "content", T.document_kind(p).alias("document_type"), title.alias("title"), T.legislation_identifier(c).alias("_id"), where.alias("_j"), T.language(F.regexp_replace(c, "<[^>]+>", " ")).alias("language"))
    rows = rows.select("path", "content", "document_type", F.col("title").alias("document_title"), "_id.identifier", "_id.type", F.col("_j.jurisdiction").alias("jurisdiction"), F.col("_j.confidence").alias("jurisdiction_confidence"), F.col("_j.method").alias("jurisdiction_method"), "language")
    keep = [x for x in rows.columns if x != "content"]
    return _mapped(rows, ["content", "document_type"], [*keep], "section_id string, title string, text string, word_count int", lambda text, kind: xml_sections(text) if kind == "xml_legislation" else law_sections(text))


def tables(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """keep, ord, rows, row_count, column_count: one row a table."""

    def parse(text: str) -> Iterator[dict]:
        for i, rows in enumerate(v for kind, v in html_nodes(text) if kind == "table" and v):
            yield {"ord": i, "rows": rows, "row_count": len(rows), "column_count": len(rows[0])}

    return _mapped(df, [html], keep, "ord int, rows array<array<string>>, row_count int, column_count int", parse)


def plain_texts(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    return _mapped(df, [html], keep, "text string", lambda t: [{"text": html_text(t)}])


def flat_text(company: DataFrame) -> DataFrame:
    """ticker, sections (array of title and text), entities (map), triples (array) -> ticker and one text."""
    s = F.transform("sections", lambda x: F.concat(F.coalesce(x.title, F.lit("")), F.lit(": "), F.coalesce(x.text, F.lit(""))))
    e = F.transform(F.map_entries("entities"), lambda x: F.concat(x.key, F.lit(": "), F.array_join(x.value, ", ")))
    t = F.transform("triples", lambda x: F.concat_ws(" ", x.subject, x.relation, x.object))
    return company.select("ticker", F.concat_ws("\n", F.concat(s, e, t)).alias("text"))
