import re

import numpy as np
import pyarrow as pa
import pytest

from test_recall import thue_morse

from stratalens.llm import kernels, lines, mixing, neardup, packing, quality, suffixes, tiff, warc

TEXTS = ["a b\tc\nd  é x", None, "", " \n\n", "word", "same same same same\nsame line\n\nsame line", "ñ" * 40 + " end", "x" * 5000]


def test_words_and_lines():
    for a, _, data, offsets in kernels.text_slices(pa.array(TEXTS), 50):
        starts, ends, rows = kernels.words(data, offsets)
        l_starts, l_ends, l_rows = kernels.lines(data, offsets)
        raw = data.tobytes()
        for i in range(len(offsets) - 1):
            text = (TEXTS[a + i] or "").encode()
            assert [raw[s:e] for s, e in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])] == re.findall(rb"[^\x20\x09-\x0D]+", text)
            assert [raw[s:e] for s, e in zip(l_starts[l_rows[i] : l_rows[i + 1]], l_ends[l_rows[i] : l_rows[i + 1]])] == [x for x in text.split(b"\n") if x.strip()]
    assert kernels.word_counts(pa.array(TEXTS)).tolist() == [6, 0, 0, 0, 1, 8, 2, 1]
    assert list(kernels.text_slices(pa.array([], pa.string()))) == []


def test_equal_spans_have_equal_hashes():
    data = np.frombuffer(b"abc xabc ABC", np.uint8)
    h = kernels.span_hashes(data, np.array([0, 5, 9, 0]), np.array([3, 8, 12, 2]), lower=True)
    assert h[0] == h[1] == h[2] != h[3]


def test_short_rows_have_one_window():
    data = np.frombuffer(b"a b c d e f a b", np.uint8)
    starts, ends, rows = kernels.words(data, np.array([0, 11, 12, 15]))
    h, at = kernels.windows(kernels.span_hashes(data, starts, ends), rows, 5, True)
    assert np.diff(at).tolist() == [2, 0, 1] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("codec", ["none", "lzw", "deflate", "packbits"])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [False, True])
def test_tiff_round_trip(codec, tile, predictor):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 255, (37, 29), np.uint8), np.repeat(rng.integers(0, 9, (20, 5, 3), np.uint8), 8, axis=1), np.zeros((300, 300), np.uint8)]
    got = list(tiff.read(tiff.write(pages, codec, predictor, rows_per_strip=11, tile=tile)))
    assert [g[7] for g in got] == [None] * 3
    assert [g[6] for g in got] == [p.tobytes() for p in pages]
    assert [g[:4] for g in got] == [(0, 29, 37, 1), (1, 40, 20, 3), (2, 300, 300, 1)]


def test_tiff_codecs_on_odd_bytes():
    for data in (b"", b"a", b"aa", b"aaa", b"abcabcabc" * 900, bytes(range(256)) * 40, np.random.default_rng(2).bytes(30_000), b"\0" * 100_000):
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_damaged_tiffs_give_rows_with_errors():
    good = tiff.write([np.zeros((4, 4), np.uint8)])
    for bad in (None, b"", b"II", b"nonsense", good[:20], good[:-8], good.replace(good[8:12], b"\0\0\0\0")):
        rows = list(tiff.read(bad))
        assert rows and rows[-1][7]


def _tiff(fields, body=b"", order="<"):
    """A file of one directory: (tag, kind, value) fields after the body."""
    import struct

    made = struct.pack(order + "H", len(fields)) + b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in fields) + b"\0" * 4
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8 + len(body)) + body + made


def test_claims_that_do_not_fit_are_errors():
    page = {256: 2, 257: 2, 258: 8, 259: 1, 273: 8, 278: 2, 279: 4}
    make = lambda **more: _tiff([(t, 4, v) for t, v in (page | {int(k[1:]): v for k, v in more.items()}).items()], b"abcd")
    (good,) = tiff.read(make())
    assert good[6] == b"abcd" and good[7] is None
    for bad in (make(_278=0), make(_256=0), make(_256=20_000_000, _257=20_000_000), make(_256=20_000_000, _257=20_000_000, _278=20_000_000), make(_322=0, _323=2, _324=8, _325=4), make(_322=1 << 31, _323=1 << 31, _324=8, _325=4), make(_277=0), make(_259=5), make(_259=7)):
        (row,) = tiff.read(bad)
        assert row[7] and row[6] is None


def test_one_bit_samples():
    (page,) = tiff.read(_tiff([(256, 3, 10), (257, 3, 2), (258, 3, 1), (259, 3, 1), (273, 4, 8), (278, 3, 2), (279, 4, 4)], bytes([0b10100000, 0b01000000, 0b1, 0b10000000])))
    assert page[6] == bytes([1, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0]) and page[4] == 1 and page[7] is None


def test_feature_is_of_the_samples():
    flat, rows = tiff.feature(b"\x10" * 64, 8), tiff.feature(bytes([0, 255] * 32), 8)
    assert flat == "mean 16.00 deviation 0.00 right 0.00 down 0.00 entropy -0.000 bands 1000,0,0,0,0,0,0,0" or "entropy 0.000" in flat
    assert rows.startswith("mean 127.50 deviation 127.50 right 255.00 down 0.00 entropy 1.000") and rows.endswith("500,0,0,0,0,0,0,500")


def test_big_endian_16_bit():
    pixels = np.arange(6, dtype=">u2").reshape(2, 3)
    (page,) = tiff.read(_tiff([(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (278, 3, 2), (279, 4, 12)], pixels.tobytes(), ">"))
    assert page[7] is None and np.frombuffer(page[6], "<u2").tolist() == [0, 1, 2, 3, 4, 5]


def test_quotas_and_flow():
    t = mixing.quotas({"a": 100, "b": 100, None: 10}, (5, 2, 1), 1.5, 2)
    assert t["a"] == pytest.approx(200) and t[None] == pytest.approx(20) and t["b"] == pytest.approx(95)
    # a document of both sources helps the one that lacks, and repeats come last
    sent = mixing.flow([(("x",), 10), (("x", "y"), 10)], {"x": 10, "y": 10}, 2)
    assert sent == [{"x": 10}, {"x": 0, "y": 10}]
    sent = mixing.flow([(("x",), 10), (("x", "y"), 10)], {"x": 25, "y": 5}, 2)
    assert sum(f.get("x", 0) for f in sent) == 25 and sent[1]["y"] == 5 and sum(sent[0].values()) <= 20 and sum(sent[1].values()) <= 20


def test_column_generation_packs_tightly():
    rng = np.random.default_rng(3)
    demand = np.bincount(rng.integers(1, 65, 5000), minlength=65)[1:]
    made = packing.plan(demand, 64)
    placed = sum(p * n for p, n in made)
    sequences = sum(n for _, n in made)
    assert (placed >= demand).all() and all(((np.arange(64) + 1) * p).sum() <= 64 for p, _ in made)
    assert sequences <= np.ceil((np.arange(1, 65) * demand).sum() / 64) * 1.02 + 1
    assert packing.plan(np.zeros(8, np.int64), 8) == []
    best, pattern = packing.knapsack(np.array([1.0, 2.5, 3.0]), 7)
    assert best == pytest.approx(8.5) and pattern.tolist() == [1, 3, 0]


def test_decision_list():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] > 0.3)) | (x["b"] < 0.05)
    rules = quality.learn({k: v[:2000] for k, v in x.items()}, bad[:2000])
    kept = rules.predict({k: v[2000:] for k, v in x.items()})
    assert 1 <= len(rules.rules) <= 12 and ((~kept) == bad[2000:]).mean() > 0.95 and (kept | bad[2000:]).mean() > 0.99
    assert quality.learn(x, np.zeros(3000, bool)).rules == [] == quality.learn(x, np.ones(3000, bool)).rules


@pytest.mark.parametrize("t", [80, 85])
def test_pairs_over_the_threshold_share_a_run(t):
    rng = np.random.default_rng(t)
    for _ in range(4000):
        u = int(rng.integers(1, 90))
        d = int(rng.integers(0, u - -(-t * u // 100) + 1))
        union = np.unique(rng.integers(0, 1 << 62, u).astype(np.uint64))
        side = rng.random(len(union)) < 0.5
        gone = np.zeros(len(union), bool)
        gone[rng.permutation(len(union))[:d]] = True
        a, b = union[~(gone & side)], union[~(gone & ~side)]
        k = len(np.intersect1d(a, b))
        if len(a) <= neardup.K and len(b) <= neardup.K and 100 * k >= t * len(np.union1d(a, b)) and not np.array_equal(a, b):
            runs = [set(neardup._runs(s[: neardup.K], neardup.run_lengths(len(s), t, 100)).tolist()) for s in (a, b)]
            assert runs[0] & runs[1]


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 8):
        runs = []
        for _ in range(n):
            words = sorted(bytes(rng.integers(97, 100, rng.integers(0, 12), np.uint8)) for _ in range(rng.integers(0, 60)))
            runs.append([(suffixes._common(words[i - 1] if i else b"", w, 0), w, b"", [(0, i)]) for i, w in enumerate(words)])
        got = list(suffixes.LoserTree([iter(r) for r in runs]))
        assert [g[1] for g in got] == sorted(w for r in runs for _, w, *_ in r)
        assert all(g[0] == suffixes._common(p[1], g[1], 0) for p, g in zip(got, got[1:], strict=False))


def test_blocks_round_trip():
    records = [(b"abcd", b"x", (1, 2)), (b"abcd", b"y", (3, 4)), (b"abz", b"", (7, 0))]
    assert [r[1:] for r in suffixes._unpack(suffixes._pack(records))] == records


def test_warc_bundle():
    b = warc.Bundle(200, 3)
    raws = [warc.record(i, "http://e.x/ü \n", b"p" * i, None if i else 5, "2025-01-01T00:00:00Z") for i in range(6)]
    for i, r in enumerate(raws):
        b.add(i, r)
    content = b.close()
    table = warc.seek_table(content)
    assert len(table) > 1
    for key, number, offset, length in b.index:
        assert warc.frame(content, table, number)[offset : offset + length] == raws[key]
    fields, block, end = warc.parse(raws[3], 0)
    assert fields["warc-type"] == "response" and block.endswith(b"\r\n\r\nppp") and end == len(raws[3])


def test_line_shingles_are_of_characters():
    data = np.frombuffer("ééaéé".encode(), np.uint8)
    _, at = lines._shingles(data, np.array([0]), np.array([len(data)]), 3)
    assert at.tolist() == [0, 3]


def test_long_spans_do_not_collide_by_pattern():
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in thue_morse())
    h = kernels.span_hashes(np.concatenate([a, b, a]), np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
    assert h[0] == h[2] != h[1]
    assert kernels.span_hashes(np.tile(a, 3000), np.array([0, 2000 * 1024]), np.array([1024, 2001 * 1024])).tolist() == [h[0]] * 2


def test_word_digests():
    data = np.frombuffer(b" A b\nc   a  B c ab c", np.uint8)
    d = kernels.word_digests(data, np.array([0, 7, 7, 9, 15, len(data)])).T.tolist()
    assert d[0] == d[3] != d[4] and d[1] == d[2] != d[0]


def test_equal_hashes_of_other_bytes_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffixes.kernels, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    group = [(0, 4, b"abcdef", b"", (1, 0)), (4, 4, b"abcdxx", b"", (2, 0)), (4, 0, b"abcdzz", b"", (3, 7))]
    assert sorted(suffixes._marks(group, 4)) == [(2, 0, 4), (3, 7, 11)]


def test_labels_few_and_many_give_rules():
    rng = np.random.default_rng(0)
    for n in (120, 4000):
        x = {"a": rng.random(n), "noise": rng.random(n)}
        bad = (x["a"] > 0.9) | (x["a"] < 0.04)
        kept = quality.learn(x, bad).predict(x)
        assert (~kept[bad]).mean() > 0.6 and kept[~bad].mean() > 0.98
    # a cluster that no rule describes does not end the covering
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.9) | (rng.random(3000) < 0.05)
    kept = quality.learn(x, bad).predict(x)
    assert (~kept[x["a"] > 0.9]).mean() > 0.95 and kept[~bad].mean() > 0.97


def test_line_shingles_by_numbers():
    """Shingles of one byte a character are counted as numbers; counts are those of strings, also beside wider lines."""
    import random

    hashed, members = lines._char_sets(8)
    rng = random.Random(4)
    alphabets = ["ab", "aA \x00", "aAé\xff", "aAé☃𐐷"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 24))).encode() for _ in range(150)]
    texts += [b"abc", b"abc" + bytes(5), b"abcdefgh", b"abcdefghi", b"xabcdefgh\xe2\x98\x83", b"abcdefgh\xff"]
    plain = [(lambda x: {x[i : i + 8] for i in range(max(1, len(x) - 7))})(t.lower().decode("utf-8", "surrogateescape")) for t in texts]
    for a, x in zip(texts, plain, strict=True):
        assert len(members(a)) == len(x)
        for b, y in zip(texts[-40:], plain[-40:], strict=True):
            assert kernels.common(members(a), members(b)) == len(x & y)
    assert isinstance(members(b"A line of plain text"), np.ndarray)


def test_marked_keys():
    bits = np.zeros(lines.MARKS // 8, np.uint8)
    keys = np.array([0, 7, 8, -1, 2**62 + 5, -(2**63)], np.int64)
    for k in keys.tolist():
        bits[k % lines.MARKS >> 3] |= 1 << (k & 7)
    assert lines.marked(bits, keys).all() and not lines.marked(bits, np.array([1, 9, -3], np.int64)).any()


def test_lists_across_batches(spark):
    """Lists that span Arrow batches, with keys that come several times: every run of several keys, and no other."""
    rows = [(r, k) for r in range(40) for k in ([5] if r % 2 else [5, r]) for _ in range(1 + 3 * (r % 5))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(x) for x in neardup.shared_lists(spark.createDataFrame(rows, "run bigint, _key bigint")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    several = {r for r, _ in rows if len({k for q, k in rows if q == r}) > 1}
    assert set(got) == {(r, k) for r, k in rows if r in several}


def test_only_wanted_line_texts_go(spark):
    """Of texts whose lines are in no bucket, none goes to the exchange, and all lines of buckets do."""
    df = spark.createDataFrame([("one line of its own\nanother line that others have",), ("a third\nanother line that others have!",)], "text string")
    every = lines.line_texts(df, "text", np.full(lines.MARKS // 8, 255, np.uint8)).collect()
    assert len(every) == 4
    wanted = [r for r in every if r._text.startswith(b"another")]
    bits = lines.marks(spark.createDataFrame([(r._key,) for r in wanted], "_key bigint"))
    assert bits.nbytes == lines.MARKS // 8
    assert {r._text for r in lines.line_texts(df, "text", bits).collect()} == {r._text for r in wanted}
