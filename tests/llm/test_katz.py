"""The Katz model against a plain one in Python, and what a language model must hold."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratalens.llm import katz
from stratalens.llm import queries as Q

K = 5


class Plain:
    """Katz backoff by dictionaries over tuples of words."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for words in texts:
            line = ["<s>", *words]
            for i in range(1, len(line)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        self.counts[k - 1][tuple(line[i - k + 1 : i + 1])] += 1
        self.d = []
        for c in self.counts:
            n = Counter(c.values())
            d = {}
            for r in range(1, K + 1):
                rest = (K + 1) * n[K + 1] / n[1] if n[1] else 1
                x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 1
                d[r] = x if 0 < x < 1 else 1
            self.d.append(d)
        self.after = defaultdict(dict)
        for c in self.counts:
            for g, n in c.items():
                self.after[g[:-1]][g[-1]] = n
        self.vocabulary = sorted({g[0] for g in self.counts[0]})

    def p(self, word, context):
        seen = self.after.get(context, {})
        d = self.d[len(context)]
        total = sum(seen.values())
        kept = sum(d.get(n, 1) * n for n in seen.values())
        if not seen and context:
            return self.p(word, context[1:])
        if kept >= total:
            total += 1
        if word in seen:
            return d.get(seen[word], 1) * seen[word] / total
        left = 1 - kept / total
        if not context:
            return left
        return left * self.p(word, context[1:]) / (1 - sum(self.p(w, context[1:]) for w in seen))

    def score(self, words):
        line, out = ["<s>", *words], 0
        for i in range(1, len(line)):
            out += math.log10(self.p(line[i], tuple(line[max(0, i - self.order + 1) : i])))
        return out


def _corpus():
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(2500)]
    texts, at = [], 0
    while at < len(words):
        n = r.randint(0, 40)
        texts.append(" ".join(words[at : at + n]))
        at += max(n, 1)
    return [*texts, None, "", "  \n", "UNSEEN things w1", "W1 W1 w1", "w1 w1 w1", "new", "ünïcode ünïcode w2", "w3 " * 3000]


def _tokens(text):
    return [*(text or "").encode().lower().decode().split(), "</s>"]


@pytest.mark.parametrize("order,chunk", [(1, 100), (2, 60), (2, 1 << 20), (3, 500)])
def test_scores_are_brute_force(spark, order, chunk):
    texts = _corpus()
    rows = [(i, t, "clash", 1, True) for i, t in enumerate(texts)] + [(None, "w1 w2", "x", 2, None), (4, texts[4], "x", 2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, words string, chunk int, held boolean").repartition(3)
    held = lambda i: i is not None and i % 5 == 1
    scored, tables = katz.score(df, held_out=F.col("doc_id") % 5 == 1, order=order, chunk=chunk, bucket=64)
    train = [_tokens(t) for i, t, *_ in rows if not held(i)]
    plain = Plain(train, order)
    n, v = sum(map(len, train)), len(plain.vocabulary)
    want = []
    for i, t, *_ in rows:
        c = [plain.counts[0][w,] for w in _tokens(t)]
        want.append((i, held(i), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), plain.score(_tokens(t))))
    order_ = lambda x: (x[0] is None, x[0] or 0, x[2])
    got = sorted(map(tuple, scored.collect()), key=order_)
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want, key=order_)]
    for a, b in zip(got, sorted(want, key=order_)):
        assert a[5] == pytest.approx(b[5], rel=1e-11) and a[6] == pytest.approx(b[6], rel=1e-9), a
    # the stored model: every n-gram's count, and every context
    model = katz.grams(tables["counts"]).groupBy("order").agg(F.count("*"), F.sum("a")).collect()
    assert {tuple(x) for x in model} == {(k + 1, len(c), sum(c.values())) for k, c in enumerate(plain.counts)}
    if order > 1:
        found = katz.grams(tables["contexts"]).groupBy("order").agg(F.count("*")).collect()
        assert {tuple(x) for x in found} == {(k, sum(len(h) == k - 1 for h in plain.after)) for k in range(2, order + 1)}


def test_probabilities_add_up(spark):
    """Over all words and the unknown one, after seen, unseen and half seen contexts: by the operator's own scores."""
    texts = [t for t in _corpus() if t]
    plain = Plain([_tokens(t) for t in texts], 2)
    heads = ["", "w1", "w2", "w7", "new", "w3", "never"]
    asked = [f"{h} {w}".strip() for h in heads for w in [*plain.vocabulary, "unknownword"] if w != "</s>"] + [h for h in heads if h]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(10_000 + i, t, True) for i, t in enumerate(asked)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h boolean")
    got = {r.doc_id: r.score for r in katz.score(df, held_out=F.col("h"))[0].collect()}
    p = {t: 10 ** got[10_000 + i] for i, t in enumerate(asked)}
    ending = lambda w: plain.p("</s>", (w,))
    for h in heads[1:]:
        start = p[h] / ending(h)  # P(h | start)
        total = sum(p[f"{h} {w}"] / ending(w) / start for w in [*plain.vocabulary, "unknownword"] if w != "</s>") + ending(h)
        assert total == pytest.approx(1, abs=1e-9), h


def test_backoff_beats_single_words_on_held_out_texts(spark, sf):
    rows = [r for r in Q.op11_katz(spark, sf).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_base_columns_of_the_query(spark, sf):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    train, lines = Counter(), {k: [*(t or "").encode().lower().split(), None] for k, t in docs.items()}
    for k, line in lines.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            train.update(line)
    n, v = sum(train.values()), len(train)
    for r in Q.op11_katz(spark, sf).collect():
        line = lines[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(line), sum(w in train for w in line), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in line), rel=1e-11)


def test_nothing_to_learn_and_nothing_to_score(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, katz.score(df, held_out=F.lit(True))[0].collect()))
    assert got == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    none, tables = katz.score(df.limit(0))
    assert none.count() == 0 and katz.grams(tables["counts"]).count() == 0
