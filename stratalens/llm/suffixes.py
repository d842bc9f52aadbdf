"""Suffix-array dedup of repeated byte strings, by a common-prefix-aware distributed merge sort of sparse suffixes.

Every string of `size` bytes has an anchor: the position of its least K-byte hash (the leftmost of equals). Equal
strings have equal anchors, so it is enough to sort the suffixes that start at anchors, one in about 40 bytes. An
anchor stands for the strings that chose it; they span its content: some bytes before it and some after it.

1. Fingerprints of anchors are exchanged; an anchor whose K bytes occur once has no repeat and goes no further.
   Occurrences that a task has seen twice itself are known to repeat: one of them is enough to tell the others, so a
   passage that a third of the documents have is not dealt to one task.
2. Contents of the others are sorted into runs by what follows the anchor. Of a run's equal contents the least place
   goes on; the other places are repeats already and are put out at once. Runs are front-coded (common prefix length,
   rest), compressed, and exchanged in blocks by fingerprint, in as many parts as the number of anchors asks for.
3. A loser tree merges the runs of a part. It knows each candidate's common prefix with the last winner, compares
   from there on only, and hands on the common prefix of neighbours.
4. Neighbours that share too little to repeat any string are dropped; the strings of the others are compared within
   groups of equal anchors: hashes find the repeats and the bytes confirm them. All but the first are marked.

Memory is bounded by a run (RUN_BYTES), by a part's compressed blocks (PART_BYTES before compression, on average), and
by the distinct contents of one anchor of K bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import kernels
from stratalens.llm.cut import cut, keyed

SIZE, K = 100, 24
RUN_BYTES, BLOCK_RECORDS, FLUSH_RECORDS = 48 << 20, 4096, 8192
PART_BYTES, ANCHOR_BYTES = 64 << 20, 200  # bytes of a part before compression, and of an anchor's content on average


def anchors(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string, last string (byte positions) and fingerprint, of all strings of the rows of a slice."""
    none = np.zeros(0, np.int64)
    n, wide = len(data), size - K + 1
    if n < size:
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n - K + 1)
    h = kernels.span_hashes(data, at, at + K)
    bits = np.uint64(int(n).bit_length())
    key = h >> bits << bits | at.astype(np.uint64)
    # sliding minimum: of prefixes and suffixes of blocks as wide as the window
    padded = np.full(-(-len(key) // wide) * wide + wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, wide)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - size + 1)
    least = np.minimum(after[starts], before[starts + wide - 1])
    # strings do not cross rows
    room = np.repeat(offsets[1:], np.diff(offsets))[starts] - starts
    starts = starts[room >= size]
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    chosen = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    ends = np.append(new[1:], len(chosen)) - 1
    return chosen[new], starts[new], starts[ends], h[chosen[new]]


def repeated(docs: DataFrame, size: int) -> DataFrame:
    """(_key, at): array of the anchors of each document whose fingerprint occurs again, in any document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for x, y, data, offsets in kernels.text_slices(b.column(1)):
                at, _, _, h = anchors(data, offsets, size)
                rows = np.searchsorted(offsets, at, "right") - 1
                doc, place = keys[x:y][rows], at - offsets[rows]
                _, first, group, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = counts[group] > 1
                spread = known.copy()
                spread[first] = False
                deal = np.where(spread, kernels.mix(h ^ kernels.mix(np.arange(len(h), dtype=np.uint64) + keys[x : x + 1].astype(np.uint64))), h)
                yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(h.view(np.int64)), pa.array(known), pa.array(doc), pa.array(place)], ["deal", "print", "known", "_key", "at"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by fingerprint; the last of a batch waits for the next one
        kept = None
        repeats = False
        for b in batches:
            h, known, key, at = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if kept is not None:
                h, known, key, at = (np.concatenate([k, v]) for k, v in zip(kept, (h, known, key, at), strict=True))
            if not len(h):
                continue
            same = np.concatenate([[repeats], h[1:] == h[:-1], [False]])
            kept, repeats = (h[-1:], known[-1:], key[-1:], at[-1:]), bool(same[-2])
            take = (same[:-1] | same[1:] | known)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][take]), pa.array(at[:-1][take])], ["_key", "at"])
        if kept is not None and (repeats or kept[1][0]):
            yield pa.RecordBatch.from_arrays([pa.array(kept[2]), pa.array(kept[3])], ["_key", "at"])

    rows = docs.mapInArrow(emit, "deal bigint, print bigint, known boolean, _key bigint, at bigint")
    found = rows.repartition("deal").select("print", "known", "_key", "at").sortWithinPartitions("print").mapInArrow(again, "_key bigint, at bigint")
    return found.groupBy("_key").agg(F.collect_list("at").alias("at"))


def _pack(records: list[tuple[bytes, bytes, tuple[int, int]]]) -> bytes:
    """A front-coded block of sorted records (after the anchor, before it reversed, place)."""
    lcps, last = [], b""
    tails, lefts, places = [], [], []
    for right, left, where in records:
        n = _common(last, right, 0)
        lcps.append(n)
        tails.append(right[n:])
        lefts.append(left)
        places.append(where)
        last = right
    head = np.array([lcps, [len(t) for t in tails], [len(x) for x in lefts]], np.uint32)
    flat = np.array(places, np.int64).reshape(-1, 2).T.copy()
    sizes = np.array([len(records), sum(map(len, tails))], np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), flat.tobytes(), head.tobytes(), *tails, *lefts]), 1)


def _unpack(block: bytes) -> Iterator[tuple[int, bytes, bytes, tuple[int, int]]]:
    """(common prefix with the record before, after the anchor, before it reversed, place)."""
    raw = zstandard.decompress(block)
    n, tail_bytes = (int(v) for v in np.frombuffer(raw, np.int64, 2))
    keys, starts = np.frombuffer(raw, np.int64, 2 * n, 16).reshape(2, n).tolist()
    lcps, tails, lefts = np.frombuffer(raw, np.uint32, 3 * n, 16 + 16 * n).reshape(3, n).tolist()
    at = 16 + 28 * n
    left_at = at + tail_bytes
    last = b""
    for lcp, tail, left, key, start in zip(lcps, tails, lefts, keys, starts, strict=True):
        last = last[:lcp] + raw[at : at + tail]
        at += tail
        yield lcp, last, raw[left_at : left_at + left], (key, start)
        left_at += left


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which at bytes are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (common prefix with the record before, string, ...) without re-comparing known prefixes.

    Each loser keeps its common prefix with the winner that passed it. Of two candidates, the one that shares more
    with the last winner comes first; only if both share as much are they compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.n = 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list = [None] * self.n  # the record each run offers
        self.lcp = [0] * self.n  # its common prefix with the last winner, as far as known
        self.lost = [-1] * self.n  # at inner nodes 1..n-1
        for i, run in enumerate(runs):
            self.head[i] = next(run, None)
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays at node. Ends of runs lose; ties go to the earlier run."""
        x, y = self.head[a], self.head[b]
        if y is None or x is None:
            win, lose = (a, b) if y is None else (b, a)
        elif self.lcp[a] != self.lcp[b]:
            win, lose = (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        else:
            at = _common(x[1], y[1], self.lcp[a])
            first = x[1][at:] < y[1][at:] or (x[1] == y[1] and a < b)
            win, lose = (a, b) if first else (b, a)
            self.lcp[lose] = at
        self.lost[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        """(common prefix with the record before, string, ...) in order."""
        while self.n and (record := self.head[self.top]) is not None:
            i = self.top
            yield (self.lcp[i], *record[1:])
            following = next(self.runs[i], None)
            self.head[i] = following
            self.lcp[i] = following[0] if following else 0
            node = (i + self.n) >> 1
            while node:
                i = self._play(node, i, self.lost[node])
                node >>= 1
            self.top = i


def _runs_of(rows: list[tuple[int, int, bytes]]) -> list[Iterator[tuple]]:
    """One stream for each run of a part, over its blocks in order."""
    blocks: dict[int, list[tuple[int, bytes]]] = {}
    for run, number, block in rows:
        blocks.setdefault(run, []).append((number, block))

    def stream(parts: list[tuple[int, bytes]]) -> Iterator[tuple]:
        last = b""
        for _, block in sorted(parts):
            for i, (lcp, right, left, where) in enumerate(_unpack(block)):
                yield (lcp if i else _common(last, right, 0)), right, left, where
                last = right

    return [stream(blocks[r]) for r in sorted(blocks)]


def _extent(left: bytes, right: bytes, where: tuple[int, int]) -> tuple[int, int, int]:
    """(key, start, end) of all strings of a content at a place."""
    return where[0], where[1], where[1] + len(left) + len(right)


def _marks(group: list[tuple[int, int, bytes, bytes, tuple[int, int]]], size: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of repeated strings, of records (common prefix with the one before, with the one after,
    after the anchor, before it reversed, place), contents different. Records of one anchor must be in one group."""
    texts, spans = [], []
    base = 0
    for before, after, right, left, where in group:
        # strings that reach no further right than a neighbour agrees
        reach = max(before, after) - size + len(left)
        if reach >= 0:
            texts.append(left[::-1] + right)
            spans.append((base, min(len(left) + len(right) - size + 1, reach + 1), *where))
            base += len(texts[-1])
    if len(spans) < 2:
        return
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    table = np.array(spans, np.int64)
    counts = table[:, 1]
    owner = np.repeat(np.arange(len(table)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = table[owner, 0] + step
    h = kernels.span_hashes(data, at, at + size)
    key, start = table[owner, 2], table[owner, 3] + step
    order = np.lexsort((start, key, h))
    repeat, twin = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    repeat[order[1:]] = h[order[1:]] == h[order[:-1]]
    twin[order[1:]] = at[order[:-1]]
    hit = np.flatnonzero(repeat)
    if not len(hit):
        return
    parts = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0) | (np.diff(at[hit] - twin[hit]) != 0)) + 1
    for part in np.split(hit, parts):
        first, last = int(at[part[0]]), int(at[part[-1]]) + size
        shift = first - int(twin[part[0]])
        if raw[first:last] == raw[first - shift : last - shift]:
            yield int(key[part[0]]), int(start[part[0]]), int(start[part[-1]]) + size
            continue
        for i in part:  # equal hashes of different bytes: look at all of the hash that come before
            text = raw[at[i] : at[i] + size]
            if any((key[j], start[j]) < (key[i], start[i]) and raw[at[j] : at[j] + size] == text for j in np.flatnonzero(h == h[i])):
                yield int(key[i]), int(start[i]), int(start[i]) + size


def _spans_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], ["_key", "start", "end"])


def _merged(rows: list[tuple[int, int, bytes]], size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Repeated spans of a part, from its runs' blocks (run, number, block)."""
    found: list[tuple[int, int, int]] = []
    group: list[list] = []
    whole = None
    for lcp, right, left, where in LoserTree(_runs_of(rows)):
        if whole is not None:
            if lcp == len(right) == len(whole[2]) and left == whole[3]:  # an equal content: the later place repeats
                if where != whole[4]:
                    found.append(_extent(left, right, max(where, whole[4])))
                    whole[4] = min(where, whole[4])
                continue
            whole[1] = lcp
            group.append(whole)
            if lcp < K and len(group) >= FLUSH_RECORDS:
                yield [*found, *_marks(group, size)]
                found, group = [], []
        whole = [lcp, 0, right, left, where]
    if whole is not None:
        group.append(whole)
    yield [*found, *_marks(group, size)]


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(_key, start, end): byte spans whose strings of size bytes start earlier too. Spans of a document may overlap."""
    docs = keyed(df, key).select(F.col(key).cast("bigint").alias("_key"), F.col(text).cast("binary").alias("_text"))
    flagged = cut(repeated(docs, size), "suffix-anchors")
    n = flagged.agg(F.sum(F.size("at"))).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * ANCHOR_BYTES // PART_BYTES, 1)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: dict[int, dict] = {}
        held_bytes = 0
        known: list[tuple[int, int, int]] = []
        task = TaskContext.get().partitionId()
        batch = lambda part, number, block: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task << 20 | made], pa.int64()), pa.array([number], pa.int32()), pa.array([block], pa.binary())], ["part", "run", "number", "block"])

        def runs() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for part, contents in sorted(held.items()):
                records = sorted((right, left, where) for (right, left), where in contents.items())
                for number, i in enumerate(range(0, len(records), BLOCK_RECORDS)):
                    yield batch(part, number, _pack(records[i : i + BLOCK_RECORDS]))
            if known:
                yield batch((task + made) % parts, -1, zstandard.compress(np.array(known, np.int64).tobytes(), 1))
            made += 1
            held.clear()
            known.clear()

        for b in batches:
            keys, wanted = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            for x, _, data, offsets in kernels.text_slices(b.column(1)):
                at, first, last, h = anchors(data, offsets, size)
                rows = np.searchsorted(offsets, at, "right") - 1
                lists = wanted.slice(x, len(offsets) - 1)
                asked = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy(zero_copy_only=False)
                take = np.flatnonzero(np.isin(at, asked))
                raw = data.tobytes()
                doc = keys[x + rows]
                low = offsets[rows]
                which = (h % np.uint64(parts)).astype(np.int64)
                for part, a, s, e, k, o in zip(which[take].tolist(), at[take].tolist(), first[take].tolist(), last[take].tolist(), doc[take].tolist(), low[take].tolist(), strict=True):
                    content, place = (raw[a : e + size], raw[s:a][::-1]), (k, s - o)
                    contents = held.setdefault(part, {})
                    before = contents.setdefault(content, place)
                    if before is place:
                        held_bytes += e - s + size + 200
                    elif before != place:
                        known.append(_extent(content[1], content[0], max(before, place)))
                        contents[content] = min(before, place)
                        held_bytes += 100
                if held_bytes > RUN_BYTES * 3:
                    yield from runs()
                    held_bytes = 0
        yield from runs()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for b in batches:
            for p, run, number, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number < 0:
                    yield _spans_batch(np.frombuffer(zstandard.decompress(block), np.int64).reshape(-1, 3).tolist())
                    continue
                if p != part and rows:
                    yield from map(_spans_batch, _merged(rows, size))
                    rows = []
                part = p
                rows.append((run, number, block))
        if rows:
            yield from map(_spans_batch, _merged(rows, size))

    sorted_runs = docs.join(flagged, "_key").select("_key", "_text", "at").mapInArrow(sort, "part int, run bigint, number int, block binary")
    return sorted_runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, "_key bigint, start bigint, end bigint")


def dedup(df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of each document: kept is its text's UTF-8 bytes without those covered
    by a string of size bytes that also starts earlier (in a smaller key, or before in the same text).

    Null and empty texts are empty; texts shorter than size keep all. Strings do not cross documents and are judged on
    the input. key tells documents apart: exactly repeated rows are one document. Rows without a key give no
    row, and a key must be an integer. Other columns are not read. An empty table gives no rows.
    """
    found = cut(spans(df, key, text, size), "suffix-spans").groupBy("_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    docs = keyed(df, key).select(F.col(key).cast("bigint").alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "n_bytes", "n_removed", "n_spans", "kept"]
        for b in batches:
            rows, held = [], 0
            for k, t, s in zip(*b.columns, strict=True):
                raw, removed, runs, at, kept = t.as_py(), 0, 0, 0, []
                for span in sorted((x["start"], x["end"]) for x in s.as_py() or ()):
                    if span[0] > at or not runs:
                        kept.append(raw[at : span[0]])
                        runs += 1
                        at = span[0]
                    removed += max(0, span[1] - at)
                    at = max(at, span[1])
                kept.append(raw[at:])
                rows.append((k.as_py(), len(raw), removed, runs, b"".join(kept)))
                held += len(raw)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)

    out = docs.join(found, "_key", "left").select("_key", "_text", "spans").mapInArrow(strip, "_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("_key", key)
