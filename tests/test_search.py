"""The keyword automaton and the vector index against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import tags, vocab
from stratalens.operators import vectors


def test_labels_are_those_of_a_loop(spark):
    r = random.Random(2)
    words = list({"".join(r.choice("abcä") for _ in range(r.randint(1, 5))) for _ in range(1200)})
    vocabulary = {f"L{i}": words[i * 3 : i * 3 + 4] for i in range(len(words) // 3)}  # neighbours share a keyword
    texts = ["".join(r.choice("abcäÄ B ") for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", "A" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = tags.labels_of(F.col("text"), {"first": vocabulary, "second": words, "none": {}})
    whole = tags.labels(F.col("text"), vocabulary, whole_words=True)
    for x in rows.select("id", found.alias("f"), whole.alias("w")).collect():
        low = (texts[x.id] or "").lower()
        assert x.f.first == sorted(k for k, ws in vocabulary.items() if any(w in low for w in ws))
        assert x.f.second == sorted({w.title() for w in words if w in low}) and x.f.none == []
        apart = set(re.findall(r"\w+", low))
        assert x.w == sorted(k for k, ws in vocabulary.items() if apart & set(ws))


def test_the_text_is_read_once_whatever_the_vocabulary(spark):
    """One Python evaluation in the plan, and its work does not follow the number of keywords."""
    rows = spark.range(3).select(F.lit("supply chain in china").alias("text"))
    three = tags.labels_of(F.col("text"), {"a": vocab.FILING_COUNTRIES, "b": vocab.FILING_OPERATIONS, "c": vocab.FILING_RISKS})
    plan = rows.withColumn("n", three).select("n.a", "n.b", "n.c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    small, large = (tags.Matcher({"x": [f"word{i}" for i in range(n)]}) for n in (10, 20_000))
    assert small.labels("a word7 b") == {"x": ["Word7"]} and large.labels("a word7 b")["x"] == ["Word7"]


def _exact(rows, queries, k, label=False):
    out = {}
    for q, qv, ql in queries:
        if qv is None or len(qv) != 3 or any(v is None for v in qv) or not any(qv):
            continue
        found = []
        for key, v, lab in rows:
            if v is not None and len(v) == 3 and all(x is not None for x in v) and any(v) and (not label or ql is None or lab == ql):
                a, b = np.array(v), np.array(qv)
                found.append((-round(float((a / np.linalg.norm(a)) @ (b / np.linalg.norm(b))), 9), key))
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("cells,label", [(1, False), (9, False), (None, True)])
def test_search_is_a_full_scan(spark, tmp_path, cells, label):
    r = random.Random(8)
    rows = [(i, [r.gauss(c, 0.1) for c in ((1, 0, 0), (0, 1, 0), (0, 0, -1), (1, 1, 1))[i % 4]], str(i % 4)) for i in range(900)]
    rows += [(2000 + i, [0.5, 0.5, 0.25], "same") for i in range(30)] + [(3000, None, "0"), (3001, [0.0, 0.0, 0.0], "0"), (3002, [1.0, None, 0.0], "0"), (3003, [1.0, 2.0], None), (3004, [1e-9, 0.0, 0.0], None)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id bigint, embedding array<double>, label string, cell string").repartition(4)
    asked = [x for x in rows if x[0] % 50 == 0 or x[0] > 2999] + [(5000, [-1.0, -1.0, -1.0], "none such"), (5001, [0.5, 0.5, 0.25], None)]
    queries = spark.createDataFrame(asked, "vec_id bigint, embedding array<double>, label string")
    index = vectors.build(df, f"file://{tmp_path}/index", size=3, cells=cells, label="label" if label else None)
    assert index.rows == 931 and index.blocks.agg(F.sum("n")).first()[0] == 931
    got = {}
    for x in vectors.search(index, queries, 7, label="label" if label else None).orderBy("query", "rank").collect():
        got.setdefault(x.query, []).append((-round(x.similarity, 9), x.key))
    want = _exact(rows, asked, 7, label)
    assert {q: [s for s, _ in v] for q, v in got.items()} == {q: [s for s, _ in v] for q, v in want.items() if v}
    assert got[5001][:7] == [(-1.0, 2000 + i) for i in range(7)] or label
    if cells == 9:
        share = vectors.share_compared(index, vectors.candidates(index, queries, 7), len(want))
        assert 0 < share < 0.5


def test_an_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<double>")
    index = vectors.build(df, f"file://{tmp_path}/none", size=3)
    assert index.rows == 0 and vectors.search(index, spark.createDataFrame([(1, [1.0, 0.0, 0.0])], df.schema)).count() == 0
