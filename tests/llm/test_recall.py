"""Near-duplicate lines and documents of a whole table against brute force: no link is lost, none is added."""

import re

import numpy as np
import pytest

from stratalens.llm import lines, neardup

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def links(sets, num):
    """All pairs of sets (by place) with 100 * intersection >= num * union, by counting over an inverted index."""
    ids, lists = {}, []
    for s in sets:
        lists.append(np.array([ids.setdefault(v, len(ids)) for v in s], np.int64))
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in lists])
    flat = np.concatenate(lists)
    order = np.argsort(flat, kind="stable")
    at = np.searchsorted(flat[order], np.arange(len(ids) + 1))
    size = np.array([len(x) for x in lists])
    for i, x in enumerate(lists):
        if len(x):
            both = np.bincount(np.concatenate([owner[order[at[t] : at[t + 1]]] for t in x]), minlength=len(sets))
            hit = np.flatnonzero((100 * both >= num * (size[i] + size - both)) & (both > 0))
            yield from ((i, int(j)) for j in hit if j > i)


def united(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(x) for x in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_no_document_link_is_lost(spark, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        sets.append(set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} - {()})
    for num in (80, 85):
        want = united(len(rows), links(sets, num))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, num=num).collect()}
        assert got == {k: (len(sets[i]), rows[want[i]][0]) for i, (k, _) in enumerate(rows)}


def test_no_line_link_is_lost(spark, docs):
    every = [((r.doc_id, i), x) for r in sorted(docs.collect(), key=lambda r: r.doc_id) for i, x in enumerate(x for x in (r.text or "").split("\n") if WORD.search(x))]
    low = [x.encode().lower().decode() for _, x in every]
    first = {}
    for i, (_, x) in enumerate(every):
        first.setdefault(x, i)
    distinct = sorted(first.values())
    found = list(links([{low[i][j : j + 8] for j in range(max(1, len(low[i]) - 7))} for i in distinct], 80))
    assert len(found) > 100
    want = united(len(every), [(first[x], i) for i, (_, x) in enumerate(every)] + [(distinct[a], distinct[b]) for a, b in found])
    got = {(r.doc_id, r.line): (r.kept_key, r.kept_line) for r in lines.find(docs).collect()}
    assert got == {o: every[want[i]][0] for i, (o, _) in enumerate(every)}


def thue_morse():
    """Two texts without a common shingle whose polynomial hashes modulo 2**64 agree, whatever the base."""
    rng = np.random.default_rng(0)
    c = rng.integers(97, 120, 1024)
    t = np.array([bin(i).count("1") & 1 for i in range(1024)])
    return bytes((c + t).astype(np.uint8)).decode(), bytes((c + 1 - t).astype(np.uint8)).decode()


def test_colliding_texts_stay_apart(spark):
    a, b = thue_morse()
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert all(r.kept for r in lines.find(df).collect())
    assert all(r.kept for r in neardup.near_duplicates(df).collect())


def test_equal_sets_of_other_sequences_are_one(spark):
    df = spark.createDataFrame([(1, "x x x x x"), (2, "X x x x x x x"), (3, "a b c d e a b c d e"), (4, "a b c d e a b c d e a b c d e"), (5, "x x x x")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


@pytest.mark.parametrize("original", [True, False])
def test_a_group_of_edited_lines(spark, original):
    """Hundreds of variants of one line, with its original and without it: the prefix filter's ground."""
    import random

    r = random.Random(5)
    base = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(24)]
    texts = [" ".join(base)] if original else []
    while len(texts) < 400:
        w = list(base)
        for _ in range(r.randint(1, 4)):
            at = r.randrange(len(w))
            w[at] = r.choice(["", "x", f"{r.randrange(10**5)}", w[at] + "s"])
        texts.append(" ".join(w))
    want = united(400, list(links([{t[j : j + 8] for j in range(max(1, len(t) - 7))} for t in texts], 80)))
    got = {x.doc_id: x.kept_key for x in lines.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == dict(enumerate(want))


def test_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2**53 + 1, "a b c d e f"), (None, None), (2**53 + 3, None)], "doc_id bigint, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()} == {(2**53 + 1, 2**53 + 1), (2**53 + 3, 2**53 + 3)}
    assert [(r.doc_id, r.kept_key) for r in lines.find(df).collect()] == [(2**53 + 1, 2**53 + 1)]
    named = df.selectExpr("CAST(doc_id AS string) AS doc_id", "text")
    for f in (lines.find, neardup.near_duplicates):
        with pytest.raises(TypeError):
            f(named)
