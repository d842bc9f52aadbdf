"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct word shingles. Its sketch is the k smallest of their hashes, in order. Sketches are
inverted on runs of consecutive retained values: two sets that differ in d of the u values of their union share
u - d values in at most d + 1 runs, so a pair over the threshold always shares a run of a length that follows from u
(see run_lengths) when the sets fit in their sketches; in longer sets it shares one unless every stretch of that
length among random retained values is broken, which has odds of at most MISS right at the threshold and fewer above
it. Runs keep a passage that thousands of documents share from pairing them all, which single values would.

Documents with equal sequences of words (by a 128-bit digest) are one class from the start; only its least key goes on.
Lists are looked at without emitting their pairs (see unite): each class is first compared with one member of its
list, the one whose runs the most others share (of edited copies, the original). An exact bound from what each member
has changed of that one's set says which further pairs can reach the threshold, so that a group of thousands of edited
copies makes pairs only for members that its original does not settle, and only with copies that share edits.

Candidates whose union sketch estimates a similarity far below the threshold are dropped; the rest is confirmed on
full sets of word tuples.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import kernels
from stratalens.llm.components import components
from stratalens.llm.cut import cut, discard, join_one, keyed

K, GROUP, MISS = 64, 256, 2e-5
BITS = 2048  # of the maps that say which tokens an edited copy has gained or lost


@lru_cache
def longest_run(num: int, den: int) -> int:
    """The longest run length whose odds of being broken everywhere among K random retained values, of which num / den
    are shared, are at most MISS."""
    for length in (6, 5, 4, 3):
        state = np.eye(1, length)[0]  # odds of each length of the run that is open
        for _ in range(K - 4):
            state = np.append(state.sum() * (1 - num / den), state[:-1] * num / den)
        if state.sum() <= MISS:
            return length
    return 2


def run_lengths(n: int, num: int, den: int) -> list[int]:
    """Lengths of runs that a set of n emits: for each union u that it can have with a set over the threshold."""
    out = set()
    for u in range(n, min(n * den // num, 4 * K) + 1):
        d = u - -(-num * u // den)
        out.add(max(1, min(longest_run(num, den), -(-(u - d) // (d + 1)))))
    return sorted(out) or [longest_run(num, den)]


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, rows = kernels.words(data, offsets)
    hashes = kernels.span_hashes(data, starts, ends, lower=True)
    shingles, at = kernels.windows(hashes, rows, words, whole_if_short=True)
    for i in range(len(at) - 1):
        yield kernels.distinct(shingles[at[i] : at[i + 1]])


def _runs(s: np.ndarray, lengths: Sequence[int]) -> np.ndarray:
    out = []
    for r in lengths:
        if len(s) >= r:
            value = np.full(len(s) - r + 1, r, np.uint64)
            for i in range(r):
                value *= np.uint64(0x9DDFEA08EB382D69)
                value += s[i : len(s) - r + 1 + i]
            out.append(kernels.mix(value))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def prints(df: DataFrame, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """(_key, n, set_a, set_b, runs): the size of each document's set, 128 bits that stand for its sequence of words,
    and its runs of retained values."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths: dict[int, list[int]] = {0: []}
        for b in batches:
            for x, y, data, offsets in kernels.text_slices(b.column(1)):
                sizes, runs = [], []
                for s in _sets(data, offsets, words):
                    n = len(s)
                    if n not in lengths:
                        lengths[n] = run_lengths(n, num, den)
                    sizes.append(n)
                    runs.append(_runs(s[:K], lengths[n]).view(np.int64))
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array(sizes, pa.int64()), *map(pa.array, kernels.word_digests(data, offsets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(runs)))],
                    ["_key", "n", "set_a", "set_b", "runs"],
                )

    rows = keyed(df, key).select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(fingerprint, "_key bigint, n bigint, set_a bigint, set_b bigint, runs array<bigint>")


def shared_lists(rows: DataFrame) -> DataFrame:
    """The rows (run, _key) whose run has several keys, once each; a row that comes several times, and in a run that
    spans Arrow batches, may be given once a batch, which changes no pair. Sorted within partitions, by the one number
    that Spark sorts by its digits, and read as a stream: no list is held."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by run; of the run that a batch ends in, the first key waits until another key shows
        last = first = None
        several = False  # whether the run that a batch ended in has had another key than its first
        for b in batches:
            run, key = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(run):
                continue
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            sizes = np.diff(np.append(starts, len(run)))
            heads = key[starts]
            goes_on = run[0] == last
            if goes_on:
                heads[0] = first
            lists = np.logical_or.reduceat(key != np.repeat(heads, sizes), starts)
            waited = goes_on and lists[0] and not several
            lists[0] |= goes_on and several
            take = np.repeat(lists, sizes)
            out_run, out_key = run[take], key[take]
            if waited:
                out_run, out_key = np.append(out_run, last), np.append(out_key, first)
            order = np.lexsort((out_key, out_run))
            out_run, out_key = out_run[order], out_key[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (out_run[1:] != out_run[:-1]) | (out_key[1:] != out_key[:-1])
            last, first, several = run[-1], heads[-1], bool(lists[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out_run[fresh]), pa.array(out_key[fresh])], ["run", "_key"])

    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(shared, "run bigint, _key bigint")


def word_sets(words: int) -> tuple[Callable, Callable]:
    """The hashed sets of a slice's rows, and the full set of one text."""

    def members(raw: bytes) -> set:
        w = raw.lower().split()  # bytes: folds A-Z, splits at the six spaces
        return set(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else {tuple(w)} - {()}

    return lambda data, offsets: _sets(data, offsets, words), members


def confirm(pairs: DataFrame, texts: DataFrame, how: tuple[Callable, Callable], num: int, den: int, sketch: bool = True, edits: bool = False) -> DataFrame:
    """(a, b, linked, n, size, both, edits) of the pairs (a, b): whether the full sets have den * intersection >= num *
    union; and, if asked for and a has several b, what bounded_pairs() needs: the sizes of b's and of a's set, what
    they share (of hashed sets), and a map of what one has and the other has not.

    The texts of one side are grouped by the other, in groups of about GROUP, and read as a stream: a text moves once
    for each of its groups. With sketch, a union sketch that estimates six standard errors too little spares the rest.
    Hashed sets come next; pairs that they do not put under the threshold are decided by full sets.
    """
    per = pairs.groupBy("a").agg(F.count("*").alias("_n"))
    wide = (F.col("_n") > 1) & F.lit(edits)
    grouped = pairs.join(per, "a").select("a", "b", wide.alias("wide"), F.xxhash64("a", F.pmod(F.xxhash64("b"), F.expr(f"_n div {GROUP} + 1"))).alias("g"))
    asked = grouped.select("g", "a", F.lit(0).alias("role"), F.col("a").alias("_key"), F.lit(False).alias("wide")).distinct().union(grouped.select("g", "a", F.lit(1), "b", "wide"))
    rows = asked.join(texts, "_key").select("g", "a", "role", "_key", "wide", F.col("_text").cast("binary").alias("_text"))
    hashed, members = how
    slack = 6 * math.sqrt(num / den * (1 - num / den) / K)

    def ruled_out(x: np.ndarray, y: np.ndarray) -> bool:
        if not len(x) or not len(y):
            return True
        union = np.union1d(x[:K], y[:K])[:K]
        both = np.isin(union, x[:K], assume_unique=True) & np.isin(union, y[:K], assume_unique=True)
        return both.sum() < (num / den - slack) * len(union)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = mine = full = source = None
        kinds = {"a": pa.int64(), "b": pa.int64(), "linked": pa.bool_(), "n": pa.int64(), "size": pa.int64(), "both": pa.int64(), "edits": pa.list_(pa.int64())}
        for b in batches:
            g_col, a_col, role, key, wide = (b.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(5))
            found = []
            for x, _, data, offsets in kernels.text_slices(b.column(5)):
                raw = data.tobytes()
                at = offsets.tolist()
                for row, (s, start, end) in enumerate(zip(hashed(data, offsets), at[:-1], at[1:], strict=True), x):
                    if role[row] == 0:
                        group, mine, full, source = (g_col[row], a_col[row]), s, None, raw[start:end]
                        continue
                    if group != (g_col[row], a_col[row]):
                        continue
                    linked, both, changed = False, None, None
                    if wide[row] or not sketch or not ruled_out(s, mine):
                        shared = kernels.found_in(mine, s)
                        both = int(shared.sum())
                        if wide[row]:
                            marks = np.zeros(BITS, np.uint8)
                            for part in (s[~shared], mine[~kernels.found_in(s, mine)]):
                                marks[part & np.uint64(BITS - 1)] = 1
                            changed = np.packbits(marks, bitorder="little").view(np.int64)
                        if both and both * den >= num * (len(s) + len(mine) - both):
                            full = members(source) if full is None else full
                            other = members(raw[start:end])
                            n = kernels.common(full, other)
                            linked = n * den >= num * (len(full) + len(other) - n)
                    found.append((a_col[row], key[row], linked, len(s), len(mine), both, changed))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds.values())], list(kinds))

    return rows.repartition("g").sortWithinPartitions("g", "a", "role", "_key").mapInArrow(compare, "a bigint, b bigint, linked boolean, n bigint, size bigint, both bigint, edits array<bigint>")


def around_originals(linked: DataFrame) -> DataFrame:
    """(a, b): the members b of each run with its pivot a, the member whose runs have the most members in all; of
    equals the least. Each pair once."""
    counts = linked.groupBy("run").agg(F.count("*").alias("_n"))
    shared = linked.join(counts, "run").groupBy("_key").agg(F.sum("_n").alias("_shared"))
    pivots = linked.join(shared, "_key").groupBy("run").agg(F.max_by("_key", F.struct("_shared", F.bitwise_not("_key"))).alias("a"))
    return linked.join(pivots, "run").where("_key != a").select("a", F.col("_key").alias("b")).distinct()


def stars(links: DataFrame) -> DataFrame:
    """(node, component) of the ends of links (a, b): nodes of one component are connected. Each node takes the one
    that the most are linked to of itself and its a's, twice; what lies further apart keeps different components."""
    hubs = links.groupBy("a").agg(F.count("*").alias("_n"))
    near = links.join(hubs, "a").select(F.col("b").alias("node"), "_n", F.col("a").alias("top")).union(hubs.select(F.col("a").alias("node"), "_n", F.col("a").alias("top")))
    once = near.groupBy("node").agg(F.max_by("top", F.struct("_n", F.bitwise_not("top"))).alias("top"))
    return once.join(once.select(F.col("node").alias("top"), F.col("top").alias("component")), "top").select("node", "component")


def bounded_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of different components, among the members (a: the pivot, b, component, n, size, both,
    edits) of a pivot's lists, that can reach the threshold.

    A member is its pivot's set but for its edits, the tokens that one of the two has and the other has not. Two
    members share as many tokens as both share with the pivot, less the pivot's, plus their common edits; and of their
    edits they have no more in common than their maps of edits show. So the bound is exact, no pair over the threshold
    is left out, and members that were edited in different places make no pair. Members of a pivot's most frequent
    component do not meet each other.
    """
    words = [f"e{i}" for i in range(BITS // 64)]
    rows = members.select(F.col("a").alias("pivot"), F.col("b").alias("_key"), "component", "n", "size", "both", (F.col("n") + F.col("size") - 2 * F.col("both")).alias("changed"), *[F.get("edits", i).alias(w) for i, w in enumerate(words)])
    rows = rows.withColumn("spare", F.col("changed") - sum((F.bit_count(w) for w in words), F.lit(0)))
    most = rows.groupBy("pivot", "component").agg(F.count("*").alias("_c")).groupBy("pivot").agg(F.count("*").alias("_parts"), F.max_by("component", F.struct("_c", "component")).alias("most")).where("_parts > 1").drop("_parts")
    rows = rows.join(most, "pivot")
    # common edits that the threshold asks for
    need = f"CAST(ceil({num}D * (x.n + y.n) / {num + den} - 1e-9) AS bigint) - x.both - y.both + x.size"
    common = " + ".join(f"bit_count(x.{w} & y.{w})" for w in words)
    fits = f"{den} * x.n >= {num} * y.n AND {den} * y.n >= {num} * x.n AND least(x.changed, y.changed) >= {need} AND {common} + least(x.spare, y.spare) >= {need}"
    other = "x.component != y.component AND (y.component = y.most OR x._key < y._key)"
    pairs = rows.where("component != most").alias("x").join(rows.alias("y"), F.expr(f"x.pivot = y.pivot AND {other} AND {fits}"))
    return pairs.select(F.least("x._key", "y._key").alias("a"), F.greatest("x._key", "y._key").alias("b"))


def unite(linked: DataFrame, texts: DataFrame, how: tuple[Callable, Callable], num: int, den: int, sketch: bool = True) -> DataFrame:
    """(node, component) of the links over the threshold among the members of lists (run, _key).

    Every member is compared with its lists' pivots, which decides these pairs; stars() unites the linked ones. Of the
    others, those that bounded_pairs() lets through are compared. Both steps are exact: no pair of a list that is over
    the threshold is left out, and none is sampled; members that are united already need no look.
    """
    first = cut(around_originals(linked), "near-pivots")
    seen = cut(confirm(first, texts, how, num, den, sketch, edits=True), "near-links")
    links = seen.where("linked").select("a", "b")
    parts = stars(links)
    known = seen.where("edits IS NOT NULL").join(parts, seen["b"] == parts["node"], "left").withColumn("component", F.coalesce("component", "b"))
    more = cut(bounded_pairs(known.drop("node", "linked"), num, den).distinct(), "near-pairs")
    again = cut(confirm(more, texts, how, num, den, sketch), "near-links")
    parts = components(links.union(again.where("linked").select("a", "b")))
    discard(first, seen, more, again)
    return parts


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row: the size of its set, the smallest key reachable over links
    (similarity of at least num / den), and whether it is its own.

    Texts that are null, empty or without a word have an empty set and no links. With fewer words than a shingle the
    whole sequence is one. Repeated rows share a component; rows that share a key but not a text are given each, under
    the key's component. Rows without a key give no row; a key must be an integer. Other columns are not read. An
    empty table: no rows.
    """
    found = cut(prints(df, key, text, words, num, den), "near-sets")
    classes = cut(found.where("n > 0").groupBy("set_a", "set_b").agg(F.min("_key").alias("_class"), F.count("*").alias("_n")).withColumn("set", F.struct("set_a", "set_b")).select("set", "_class", "_n"), "near-classes")
    placed = join_one(found.where("n > 0").select("_key", "n", F.struct("set_a", "set_b").alias("set")), classes, "set").select("_key", "n", "_class")
    # one document speaks for its class
    runs = found.join(classes.select(F.col("set.set_a"), F.col("set.set_b"), F.col("_class").alias("_key")), ["set_a", "set_b", "_key"]).select(F.explode("runs").alias("run"), "_key")
    linked = cut(shared_lists(runs), "near-lists")
    texts = keyed(df, key).select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    texts = cut(texts.join(linked.select("_key").distinct(), "_key").groupBy("_key").agg(F.min("_text").alias("_text")), "near-texts")
    parts = unite(linked, texts, word_sets(words), num, den)
    discard(texts, linked)
    full = placed.union(found.where("n = 0").select("_key", "n", F.col("_key").alias("_class")))
    ends = full.join(parts.withColumnRenamed("node", "_class"), "_class", "left").select("_key", "n", F.coalesce("component", "_class").alias("component_id"))
    return ends.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), "component_id", (F.col("_key") == F.col("component_id")).alias("kept"))
