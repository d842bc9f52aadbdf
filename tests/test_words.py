"""Lemmas, languages, encodings of files, and traversal, against stated results."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from stratalens.functions import lemmas
from stratalens.operators import documents, graph, language
from stratalens.sources import readers

FORMS = {
    "company": "companies", "policy": "policies", "risk": "risks", "tax": "taxes", "process": "processes", "business": "business businesses", "loss": "losses", "branch": "branches",
    "analysis": "analysis analyses", "criterion": "criteria", "index": "indices", "child": "children", "woman": "women", "be": "is are was were", "have": "has had", "make": "made makes making",
    "regulate": "regulates regulated regulating", "operate": "operates operated operating", "manufacture": "manufactures manufactured manufacturing", "require": "requires required requiring",
    "increase": "increases increased increasing", "provide": "provides provided providing", "decline": "declines declined declining", "manage": "manages managed managing", "change": "changes changed changing",
    "control": "controls controlled controlling", "plan": "plans planned planning", "occur": "occurred occurring", "sell": "sells sold selling", "comply": "complies complied complying",
    "report": "reports reported reporting", "expect": "expects expected expecting", "limit": "limits limited limiting", "train": "trains trained training", "explain": "explained explaining",
    "measure": "measures measured measuring", "secure": "secured securing", "close": "closes closed closing", "use": "uses used using", "include": "includes included including", "file": "files filed filing",
    "reduce": "reduces reduced reducing", "believe": "believes believed", "charge": "charged charging", "store": "stores stored storing", "compare": "compared comparing", "combine": "combined combining",
    "execute": "executed executing", "call": "calls called calling", "access": "accessed accessing", "discuss": "discussed discussing", "monitor": "monitored monitoring", "engage": "engages engaged engaging",
    "propose": "proposed proposing", "revise": "revised revising", "develop": "developed developing", "refer": "referred referring", "purchase": "purchased purchasing", "string": "string", "thing": "things",
    "need": "need needs", "proceed": "proceeds", "series": "series", "various": "various", "this": "this", "news": "news", "during": "during", "customer": "customer's customers", "hope": "hoped hoping", "ship": "ships shipped shipping",
    "issue": "issues issued issuing", "continue": "continues continued continuing", "acquire": "acquired acquiring", "study": "studies studied studying", "carry": "carries carried carrying", "play": "plays played playing", "enable": "enables enabled enabling",
}


@pytest.mark.parametrize("lemma", sorted(FORMS))
def test_inflected_forms(lemma):
    for form in [*FORMS[lemma].split(), lemma]:
        assert lemmas.lemma(form) == lemma and lemmas.lemma(form.title()) == lemma


def test_lemmas_of_texts_and_of_documents(spark):
    rows = spark.createDataFrame([(1, "The Companies’ risks, increased; WERE reported!"), (2, None), (3, "größere 数据 x_1 !!"), (4, "the of")], "id int, text string")
    got = {r.id: r.l for r in rows.select("id", lemmas.lemmas(F.col("text"), ["the", "be", "of"]).alias("l")).collect()}
    assert got == {1: "company risk increase report", 2: "", 3: "größere 数据 x 1", 4: ""}
    sections = spark.createDataFrame([("T", "Risks", "<p>Our factories were closed.</p>", "html_filing")], "ticker string, title string, text string, document_type string")
    out = documents.process(sections, ["ticker"], lemmatise=True, stop_words=["our"]).collect()
    assert [r.chunk_text for r in out] == ["factory be close"]


def test_languages_are_learned_from_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = language.fit(docs.where("doc_id % 5 <> 1"))
    assert profiles.languages == sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang)
    held_out = docs.where("doc_id % 5 = 1 AND length(trim(text)) >= 20")
    assert held_out.count() > 20 and language.accuracy(held_out, profiles) >= 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "日本語です")], "id int, text string")
    got = {r.id: r.l for r in odd.select("id", language.detect(F.col("text"), profiles).alias("l")).collect()}
    assert got[1] is got[2] is got[3] is None and got[4] in profiles.languages
    nothing = language.fit(docs.limit(0))
    assert nothing.languages == [] and odd.select(language.detect(F.col("text"), nothing)).distinct().count() == 1


def test_each_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "one two.csv").write_bytes('Symbol,Company Name\nAAA,Café Müller\nBBB,"two\nlines, ""quoted"""\n'.encode())
    (tmp_path / "latin.csv").write_bytes("Symbol,Company Name\nCCC,Café Müller\n".encode("latin-1"))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "other.csv").write_bytes("Symbol,Company Name,Née\nDDD,Łódź,x\n".encode()[:0] + "Symbol,Company Name\nDDD,Łódź\n".encode())
    df = readers.csv(spark, str(tmp_path))
    assert df.columns == ["symbol", "company_name"]
    assert {r.symbol: r.company_name for r in df.collect()} == {"AAA": "Café Müller", "BBB": 'two\nlines, "quoted"', "CCC": "Café Müller", "DDD": "Łódź"}
    assert [f.rsplit("/", 1)[1] for f in readers.not_utf8(spark, str(tmp_path))] == ["latin.csv"]
    assert readers.csv(spark, str(tmp_path / "latin.csv")).first().company_name == "Café Müller"


def _breadth_first(links, start, depth, most):
    near = {}
    for a, b in links:
        if a != b and a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    hops, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        if hops[x] < depth and (x == start or most is None or len(near.get(x, ())) <= most):
            for y in near.get(x, ()):
                if y not in hops:
                    hops[y] = hops[x] + 1
                    queue.append(y)
    return {(start, y, h, most is not None and len(near[y]) > most) for y, h in hops.items() if h}


@pytest.mark.parametrize("most", [None, 12])
def test_traversal_is_breadth_first(spark, most):
    r = random.Random(6)
    links = [(f"v{i}", f"v{i + 1}") for i in range(40)] + [("hub", f"v{i}") for i in range(0, 40, 2)] + [(f"v{r.randrange(60)}", f"v{r.randrange(60)}") for _ in range(15)]
    links += [("v1", "v1"), ("v3", None), (None, None), links[0], ("x", "y")]
    edges = spark.createDataFrame([(a, b, "T", 1) for a, b in links], "source string, target string, type string, hops int")
    starts = ["v0", "v0", "v33", "hub", "x", "alone", None]
    got = graph.expand(edges, spark.createDataFrame([(s,) for s in starts], "id string"), 9, most).collect()
    want = set().union(*[_breadth_first(links, s, 9, most) for s in {*starts} - {None}])
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert {(a, b, h) for a, b, h in map(tuple, graph.reachable(edges, spark.createDataFrame([("v0",)], "id string"), 5).collect())} == {x[:3] for x in _breadth_first(links, "v0", 5, None)}
    assert graph.expand(edges.limit(0), spark.createDataFrame([("v0",)], "id string"), 4).count() == 0


def test_the_hashing_embedder_is_a_plain_count(spark):
    import re

    import xxhash

    from stratalens.operators import models

    texts = ["Alpha beta, beta GAMMA!", "", None, "...", "one " * 5000, "a b c d e f g"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    for r in rows.select("id", models.embed(F.col("text"), 16).alias("v")).collect():
        want = [0] * 16
        for w in re.findall(r"\w+", (texts[r.id] or "").lower()):
            want[int.from_bytes(xxhash.xxh64(w.encode(), seed=42).digest(), "big", signed=True) % 16] += 1
        norm = sum(x * x for x in want) ** 0.5 or 1
        assert r.v == pytest.approx([x / norm for x in want], rel=1e-6)


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    """Loads and batches are counted by files; vectors are those of the model, text by text."""
    import os
    import uuid

    import numpy as np

    from stratalens.operators import models

    folder = str(tmp_path)

    def load():
        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            longest = max(len(t.split()) for t in texts)
            assert len(texts) == 1 or len(texts) * longest <= 50
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])

        return model

    texts = [None, "", "  ", "x " * 400, *["a" * (i % 5 + 1) + " b" * (i % 30) for i in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(9)
    for _ in range(2):
        got = {r.id: r.v for r in rows.select("id", models.embedder(load, 3, 50)(F.col("text")).alias("v")).collect()}
        assert got == {i: [float(len(t)), float(t.count("a")), 1.0] if t and t.strip() else None for i, t in enumerate(texts)}
    loads = [f.split("-")[1] for f in os.listdir(folder)]
    assert 2 <= len(loads) <= 2 * len(set(loads))
    wrong = models.embedder(lambda: lambda texts: np.zeros((len(texts), 2)), 3)
    with pytest.raises(Exception, match="vectors of shape"):
        rows.select(wrong(F.col("text"))).collect()


def test_files_by_prefix_and_suffix(spark, tmp_path):
    """A scan of a store: everything below a prefix, whatever its depth, with a suffix."""
    for name in ("parsed/a_10k.json", "parsed/filings/T/b_10q.json", "parsed/filings/T/c.txt", "parsed-old/d_8k.json", "other/e_10k.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() + b"\xff")
    found = {r.path.rsplit("/", 1)[1]: r.content for r in readers.files(spark, f"file://{tmp_path}/parsed*", "*_10[kq].json").collect()}
    assert found == {"a_10k.json": "parsed/a_10k.json", "b_10q.json": "parsed/filings/T/b_10q.json"}
