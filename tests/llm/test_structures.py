"""Centroids and conversations against brute force, with the awkward rows."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from stratalens.llm import clusters, conversations
from stratalens.llm import queries as Q

VECTORS = "vec_id bigint, embedding array<double>, keys string, cluster int"


def _rounds(rows, components, wanted, rounds, scale=256, seed="2"):
    """(centroids, [(key, cluster, distance)]) by Python's integers."""
    good = [(k, [math.floor(v * scale) for v in x]) for k, x in rows if x is not None and len(x) == components and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted((hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), x) for k, x in good if k is not None)
    centroids = [x for _, x in order[:wanted]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    place = lambda x: min(range(len(centroids)), key=lambda k: far(x, centroids[k]))
    for _ in range(rounds):
        groups = {}
        for _, x in good:
            groups.setdefault(place(x), []).append(x)
        for k, xs in groups.items():
            centroids[k] = [sum(v) // len(xs) for v in zip(*xs)]
    return centroids, [(k, place(x), far(x, centroids[place(x)])) for k, x in good] if centroids else []


@pytest.mark.parametrize("size", [1.0, 3e5, 1e13])
def test_centroids_are_brute_force(spark, size):
    """Small components go through the product, large ones through Python's integers; a few huge ones mix both."""
    r = random.Random(size)
    rows = [(i, [r.gauss(0, size) for _ in range(5)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [1.0] * 5), (900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [math.nan] * 5), (904, [math.inf] + [0.0] * 4), (905, []), (906, [-0.0, 0.5, -0.5, 0.0, 1 / 256])]
    rows += [(i, [0.25] * 5) for i in range(1000, 1100)]
    rows += [(950, [9e6, -9e6, 0.0, 1.0, 2.0])]
    df = spark.createDataFrame([(*x, "clash", 3) for x in rows], VECTORS).repartition(5)
    placed, centroids, sums = clusters.cluster(df, components=5, clusters=9, rounds=4)
    want, per = _rounds(rows, 5, 9, 4)
    assert centroids == want
    got = [tuple(x) for x in placed.collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, c, d if d < 1 << 63 else None)) for k, c, d in per)
    for k in range(9):
        own = [d for _, c, d in per if c == k]
        assert sums.get(k, [0, 0])[:2] == [len(own), sum(own)]


def test_centroids_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0], "a", 1), (2, [1.0, 2.0], "a", 1)], VECTORS)
    placed, centroids, _ = clusters.cluster(few, components=2)
    assert centroids == [[256, 512], [256, 512]] and {(r.cluster, r.distance) for r in placed.collect()} == {(0, 0)}
    placed, centroids, sums = clusters.cluster(few.limit(0), components=2)
    assert centroids == [] and sums == {} and placed.count() == 0 and placed.columns == ["vec_id", "cluster", "distance"]


def test_a_distance_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(i, [1e200 * i * i, 0.0], "a", 1) for i in range(3)], VECTORS)
    placed, _, _ = clusters.cluster(df, components=2, clusters=1, rounds=1)
    assert [r.distance for r in placed.collect()] == [None] * 3


def test_the_product_meets_its_bound(spark):
    """Right below the guard and right above it distances are exact."""
    import numpy as np

    for size in (2**22 - 1, 2**22, 2**22 + 1, 2**26):
        x = np.array([[size, -size, size - 1, 1], [0, 0, 0, size]], float)
        centroids = [[-size, size, -size, 0], [size, -size, size, 3]]
        best, distance, _ = clusters.nearest(x, centroids)
        far = [[sum((int(a) - b) ** 2 for a, b in zip(row, c)) for c in centroids] for row in x]
        assert distance.tolist() == [min(f) for f in far] and best.tolist() == [f.index(min(f)) for f in far]


def _faults(turns):
    seen, out = set(), []
    for role, text in turns:
        core = text.rstrip(conversations.SPACE)
        blank, again = not core, (role, text) in seen
        seen.add((role, text))
        out.append("blank" if blank else "duplicate" if again else "truncated" if core[-1] not in ".!?" else "")
    return out


def _cheapest(turns):
    """(cost, audit, repaired) over all edits: each turn kept, reroled or deleted, at most one insert before each turn
    and two at the end (more cost more and change nothing)."""
    best, faults = None, _faults(turns)
    full = {"u": "user", "a": "assistant"}
    for edits in itertools.product("KuaD", repeat=len(turns)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        base = sum({"K": 0, "D": 3}.get(e, 2) + (e != "D" and f == "truncated") for e, f in zip(edits, faults))
        if best and base > best[0]:
            continue
        for inserts in itertools.product(["", "u", "a"], repeat=len(turns)):
            for tail in ("", "a", "ua"):
                cost = base + 2 * (sum(map(len, inserts)) + len(tail))
                if best and cost > best[0]:
                    continue
                audit, out = "", []
                for e, ins, (role, text) in zip(edits, inserts, turns):
                    audit += "I" * len(ins) + ("R" if e in "ua" else e)
                    out += [(full[i], "") for i in ins] + ([] if e == "D" else [(role if e == "K" else full[e], text)])
                audit += "I" * len(tail)
                out += [(full[i], "") for i in tail]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                    best = min(best or (cost, audit, out), (cost, audit, out))
    return best


def _random_turns(r, n):
    roles = ["user", "assistant", "system", "tool", "", " "]
    texts = ["Yes.", "No", "Why?", " ", "", "Fine!  ", "x. y", "."]
    return [(r.choice(roles[: r.choice([2, 3, 6])]), r.choice(texts) if r.random() < 0.5 else f"t{i}.") for i in range(n)]


def test_paths_are_the_cheapest_edits():
    r = random.Random(5)
    for case in range(45):
        turns = _random_turns(r, case % 5)
        facts, n = conversations._facts(turns, [1] * len(turns), [t in turns[:i] for i, t in enumerate(turns)])
        cost, audit, _ = conversations.best_end(conversations.paths(facts))
        assert (cost, *conversations.apply(audit, turns, [1] * len(turns), "", True)) == _cheapest(turns), turns
        assert [n[k] for k in ("blank", "duplicate", "truncated")] == [_faults(turns).count(k) for k in ("blank", "duplicate", "truncated")]


def _whole(rows):
    """The digest of a conversation's rows (turn, role, text) by the program over all of it."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    turns = [(a, b) for _, a, b in rows]
    facts, n = conversations._facts(turns, [1] * len(turns), [t in turns[:i] for i, t in enumerate(turns)])
    cost, audit, _ = conversations.best_end(conversations.paths(facts))
    audit, out = conversations.apply(audit, turns, [1] * len(turns), "", True)
    numbers = {t for t, *_ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    odd = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(turns, turns[1:]))
    return gaps, n["blank"], n["duplicate"], n["truncated"], odd, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


@pytest.mark.parametrize("most", [2, 3, 512])
def test_conversations_cut_in_pieces_come_out_the_same(spark, most):
    r = random.Random(9)
    convs = {c: [(r.choice([None, *range(40)]) if c % 2 else i, *t) for i, t in enumerate(_random_turns(r, n))] for c, n in enumerate([0, 1, 2, 3, 5, 8, 13, 40, 300, 7, 7, 7])}
    convs[None] = [(1, "user", "Null?"), (1, "user", "Null?"), (None, "assistant", "yes")]
    convs[8] += [(5, "user", "Same again.")] * 200
    rows = [(c, *x, "clash", 1) for c, xs in convs.items() for x in xs]
    # a conversation of nothing but rows that stand 0 times; a null number of times is once
    rows = [(*x, 1 if i % 2 else None) for i, x in enumerate(rows)] + [(77, 3, "user", "gone", "clash", 1, 0), (1, 9, "user", "gone", "clash", 1, 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, conv string, part int, copies int").repartition(7)
    repaired = conversations.repair(df, copies="copies", most=most)
    got = {x.conv: tuple(x)[1:] for x in conversations.digests(*conversations.repaired_pieces(df, copies="copies", most=most)).collect()}
    assert got == {c: _whole(xs) for c, xs in convs.items() if xs} | {77: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    kept = conversations.turns(repaired).where("conv = 8").orderBy("part", "piece", "pos").collect()
    assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in kept).encode()).hexdigest() == got[8][-1]


def test_damage(spark):
    """Every kind of damage, nulls as one space, and conversations of which nothing is left."""
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(6)] + [(None, None, None, None), (200, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(tuple(x) for x in conversations.damaged(df).where("conv_id < 100").collect())
    want = []
    for c, t, role, text in rows[:-2]:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        want.append((c, t, "user" if k == 4 else role, "" if k <= 1 else "One Two" if k == 2 else text, {0: 0, 3: 2}.get(k, 1)))
    assert got == sorted(want) and {x[4] for x in got} == {0, 1, 2}
    assert {x.text for x in conversations.damaged(df).where("turn IS NULL").collect()} <= {" ", ""}
    out = conversations.digests(*conversations.repaired_pieces(conversations.damaged(df), copies="copies"))
    assert {x.conv for x in out.collect()} == {*range(30), None, 200}
    assert conversations.digests(*conversations.repaired_pieces(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op12_centroids", "op13_conversations"])
def test_same_rows_as_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    twin = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(twin.columns)
    assert sorted(repr(tuple(r[c] for c in twin.columns)) for r in got.collect()) == sorted(map(repr, twin.fetchall()))


def test_a_text_of_a_megabyte_is_one_turn(spark):
    long = "word " * 200_000 + "end."
    df = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", "Ok."), (1, 3, "assistant", long)], "conv_id bigint, turn bigint, role string, text string")
    row = conversations.digests(*conversations.repaired_pieces(df)).select(F.col("cost"), F.col("audit")).first()
    assert tuple(row) == (2, "KKIK")


def test_a_long_candidate_costs_the_same_for_each_character(spark):
    """A hundred thousand characters, and names of as many parts: spans as for short ones, and time in proportion."""
    import time

    from stratalens.llm import secretscan

    r = random.Random(12)
    letters = secretscan.ALPHABET[:64]
    took = {}
    for n in (1000, 50_000, 100_000):
        text = "".join(r.choice(letters) for _ in range(n))
        rows = [(1, f"x {text} y"), (2, "ab-12-" * (n // 6) + "zz"), (3, "a" * n + "1"), (4, "a1" * (n // 2))]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        start = time.perf_counter()
        got = {x.doc_id: [(s.start, s.end) for s in x.entropy] for x in secretscan.scan(df).collect()}
        took[n] = time.perf_counter() - start
        assert got == {1: [(2, 2 + n)], 2: [], 3: [], 4: []}
    assert took[100_000] < 3 * took[50_000] + 2


def test_records_have_integer_keys(spark):
    from stratalens.llm import warc

    rows = [(1, "http://a/", "same"), (None, "http://b/", "same"), (2, None, "same"), (None, None, None), (3, "u", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(warc.write(df)).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}
    with pytest.raises(TypeError, match="integer"):
        warc.write(df.withColumn("page_id", F.col("page_id").cast("string")))


def test_rows_that_share_a_key_are_mixed_alike_in_every_run(spark):
    from stratalens.llm import mixing

    rows = [(i // 6, "word " * (1 + i % 5) + str(i), "ab"[i % 2]) for i in range(240)]
    runs = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts)
        runs.append(sorted(map(tuple, mixing.mix(df, share=0.7).collect()), key=repr))
    assert runs[0] == runs[1]


def test_flow_costs_as_little_as_any(spark):
    """Overlapping sources against the optimum by a linear program over all ways to send whole tokens."""
    from stratalens.llm import mixing

    r = random.Random(3)
    for _ in range(25):
        patterns = [(p, r.randint(1, 4)) for p in (("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")) if r.random() < 0.8]
        names = sorted({s for p, _ in patterns for s in p})
        target = {s: r.randint(0, 7) for s in names}
        sent = mixing.flow(patterns, target, 2)
        assert all(sum(f[s] for f, (p, _) in zip(sent, patterns) if s in p) <= target[s] for s in names)
        took = [sum(f.values()) for f in sent]
        assert all(0 <= t <= 2 * n for t, (_, n) in zip(took, patterns))
        cost = lambda took: sum(max(0, t - n) for t, (_, n) in zip(took, patterns))
        best = None
        for each in itertools.product(*[range(2 * n + 1) for _, n in patterns]):
            if best and (-sum(each), cost(each)) >= best:
                continue
            # sources can take it if every set of patterns fits in the sources that it reaches (Hall)
            fits = all(sum(each[i] for i in range(len(patterns)) if set(patterns[i][0]) <= set(sub)) <= sum(target[s] for s in sub) for k in range(len(names) + 1) for sub in itertools.combinations(names, k))
            if fits:
                best = (-sum(each), cost(each))
        assert (-sum(took), cost(took)) == best, (patterns, target)


def test_cuts_of_a_job_go_with_their_folder(spark, sf, tmp_path):
    import os

    from stratalens.llm import cut

    shared = cut.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    with cut.folder(spark) as path:
        rows = Q.op13_conversations(spark, sf)
        n = rows.count()
    assert set(os.listdir(shared)) - before == {path.rsplit("/", 1)[1]}
    rows.write.parquet(f"file://{tmp_path}/result")
    cut.drop(spark, path)
    assert set(os.listdir(shared)) == before and spark.read.parquet(f"file://{tmp_path}/result").count() == n
