"""Fuzzy line dedup: of lines that say nearly the same anywhere in the corpus, the first stays.

A line is what \\n separates and that has a word; its set is its distinct shingles of `chars` characters, A-Z
lower-cased (a shorter line is one shingle). MinHash signatures over that set are banded: with 14 bands of 4 values,
a pair of similarity 0.8 shares a band with odds of 0.9994, one of 0.9 with odds of 0.9999999. Lines of a band's
bucket are candidates; they are confirmed by the exact Jaccard similarity of full sets, and united in components as
near-duplicate documents are. Lines with equal bytes, by a 128-bit digest, are one line from the start, so a line that
millions of documents have is one member of each bucket; the digest's first half names it among candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import kernels
from stratalens.llm.cut import cut, discard, hidden, join_one, keyed
from stratalens.llm.neardup import shared_lists, unite

CHARS, BANDS, ROWS = 8, 14, 4
_FACTOR = np.uint64(0x9DDFEA08EB382D69)
MOST_SEEN = 1_000_000  # lines that a task remembers to have sent
MARKS, MAP = 1 << 25, 1 << 15  # bits that say which lines may be in a bucket; bits of one of Spark's bitmaps


def _shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of each line, and the lines' offsets among them."""
    data = kernels.lower(data)
    raw = data.tobytes()
    first, last, letters = starts, ends, None
    if not raw.isascii():
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        letters = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(letters) == len(heads):
            first, last = np.searchsorted(heads, starts), np.searchsorted(heads, ends)
        else:  # not UTF-8: bytes count as characters
            letters = None
    padded = np.zeros(len(data if letters is None else letters) + chars + 1, np.uint32)
    padded[: -chars - 1] = data if letters is None else letters
    size = last - first
    runs = np.maximum(size - chars + 1, 1)
    at = np.concatenate([[0], np.cumsum(runs)])
    # two characters at a time, at every place; then the places that are shingles of a line
    pairs = np.ndarray((len(padded) - 1,), np.uint64, padded, strides=(4,))
    n = len(padded) - chars

    def hashed(part: Callable[[int], np.ndarray], one: Callable[[int], np.ndarray]) -> np.ndarray:
        h = np.full(1, chars, np.uint64)
        for i in range(0, chars, 2):
            h = h * _FACTOR + (part(i) if i + 1 < chars else one(i))
        return kernels.mix(h)

    out = hashed(lambda i: pairs[i : i + n], lambda i: padded[i : i + n])[np.arange(at[-1]) + np.repeat(first - at[:-1], runs)]
    short = np.flatnonzero(size < chars)
    if len(short):
        letter = lambda i: np.where(i < size[short], padded[first[short] + i], 0).astype(np.uint64)
        out[at[short]] = hashed(lambda i: letter(i) | letter(i + 1) << np.uint64(32), letter) ^ np.uint64(1)
    return out, at


def _signatures(shingles: np.ndarray, at: np.ndarray, values: int) -> np.ndarray:
    """values minima of multiplied hashes for each line."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.empty((values, len(at) - 1), np.uint32)
    factors = (kernels.mix(np.arange(1, values + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for i, factor in enumerate(factors):
        out[i] = np.minimum.reduceat(low * factor, at[:-1])
    return out


def _digests(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A slice's bytes; start, end and digest of its lines; and the rows' offsets among the lines."""
    starts, ends, rows = kernels.lines(data, offsets)
    raw = data.tobytes()
    return raw, starts, ends, kernels.digests(raw, starts.tolist(), ends.tolist()), rows


def occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, line, _line, _rest): every line with a word, by number (0 first), and the halves of its bytes' digest."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for x, y, data, offsets in kernels.text_slices(b.column(1)):
                _, starts, _, digests, rows = _digests(data, offsets)
                n = np.diff(rows)
                number = np.arange(len(starts)) - np.repeat(rows[:-1], n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[x:y], n)), pa.array(number), *map(pa.array, digests)], ["_key", "line", "_line", "_rest"])

    rows = keyed(df, key).select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(find, "_key bigint, line bigint, _line bigint, _rest bigint")


def buckets(df: DataFrame, text: str, chars: int, bands: int, rows: int) -> DataFrame:
    """(run, _key): lines (by the first half of their digest) of the buckets that several lines share."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # spares a line that comes again to this task; sent again, it would do no harm
        for b in batches:
            for _, _, data, offsets in kernels.text_slices(b.column(0), 64 << 10):
                _, starts, ends, digests, _ = _digests(data, offsets)
                names, once = np.unique(digests[0], return_index=True)
                new = np.array([n not in seen for n in names.tolist()], bool)
                names, once = names[new], once[new]
                if not len(once):
                    continue
                if len(seen) > MOST_SEEN:
                    seen.clear()
                seen.update(names.tolist())
                shingles, at = _shingles(data, starts[once], ends[once], chars)
                signature = _signatures(shingles, at, bands * rows)
                value = np.repeat(np.arange(1, bands + 1, dtype=np.uint64), len(once)).reshape(bands, -1)
                for r in range(rows):
                    value *= np.uint64(0x9DDFEA08EB382D69)
                    value += signature[r::rows]
                yield pa.RecordBatch.from_arrays([pa.array(kernels.mix(value.ravel()).view(np.int64)), pa.array(np.tile(names, bands))], ["run", "_key"])

    found = df.select(F.col(text).alias("_text")).mapInArrow(band, "run bigint, _key bigint")
    return shared_lists(found)


def marks(keys: DataFrame) -> np.ndarray:
    """A map of MARKS bits, 4 MB for any input: the bits that the numbers _key end in are set."""
    bit = F.pmod("_key", F.lit(MARKS))
    dealt = keys.select(F.floor(bit / MAP).alias("_map"), (bit % MAP).alias("_bit")).repartition("_map")
    out = np.zeros((MARKS // MAP, MAP // 8), np.uint8)
    for number, bits in dealt.groupBy("_map").agg(F.bitmap_construct_agg("_bit")).collect():
        out[number] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of a map: all that are, and of the others as many as the map is full."""
    at = keys & np.int64(MARKS - 1)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1) != 0


def line_texts(df: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(_key, _rest, _text): the lines that a map of marks() names, by the halves of their digests, once a batch slice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in kernels.text_slices(b.column(0)):
                raw, starts, ends, digests, _ = _digests(data, offsets)
                names, once = np.unique(digests[0], return_index=True)
                once = once[marked(wanted, names)]
                yield pa.RecordBatch.from_arrays([*[pa.array(d[once]) for d in digests], pa.array([raw[s:e] for s, e in zip(starts[once].tolist(), ends[once].tolist(), strict=True)], pa.binary())], ["_key", "_rest", "_text"])

    return df.select(F.col(text).alias("_text")).mapInArrow(find, "_key bigint, _rest bigint, _text binary")


def _char_sets(chars: int) -> tuple:
    def hashed(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        shingles, at = _shingles(data, offsets[:-1], offsets[1:], chars)
        for i in range(len(at) - 1):
            yield kernels.distinct(shingles[at[i] : at[i + 1]])

    def members(raw: bytes) -> set | np.ndarray:
        """The shingles; eight characters of one byte each are told by the number that these bytes make."""
        line = raw.lower()
        if chars == 8 and len(line) >= 8:
            narrow = line
            if not line.isascii():
                try:
                    narrow = line.decode("utf-8", "surrogateescape").encode("latin-1")
                except UnicodeEncodeError:
                    narrow = b""
            if len(narrow) >= 8:
                return kernels.distinct(np.ndarray((len(narrow) - 7,), "<u8", narrow, strides=(1,)))
        line = line.decode("utf-8", "surrogateescape")
        return {line[i : i + chars] for i in range(max(1, len(line) - chars + 1))}

    return hashed, members


def find(df: DataFrame, *, key: str = "doc_id", text: str = "text", chars: int = CHARS, bands: int = BANDS, rows: int = ROWS, num: int = 80, den: int = 100) -> DataFrame:
    """(key, line, kept_key, kept_line, kept): for each line with a word, the first line (by key, then number) of its
    component, and whether it is that line.

    Lines are numbered from 0 among a text's lines with a word. Null and empty texts, and texts of blank lines, have
    none; rows without a key give none, and a key must be an integer. Rows that repeat repeat their lines: all the
    copies of the first stay; rows that share a key but not a text are numbered each on its own. Other columns are not
    read. An empty table: no rows.
    """
    docs = keyed(df, key)
    linked = cut(buckets(docs, text, chars, bands, rows), "line-buckets")
    involved = linked.select("_key").distinct()
    # of lines that share half a digest, which no two are known to do, the least by the other half is looked at
    # the map spares the exchange nearly all texts that are in no bucket; where it is full, they go and the join drops them
    texts = line_texts(docs, text, marks(involved)).join(involved, "_key").groupBy("_key").agg(F.min_by("_text", "_rest").alias("_text"), F.min("_rest").alias("_rest"))
    texts = cut(texts, "line-texts")
    # lines are short: their full sets cost less than sketches would
    parts = unite(linked, texts.select("_key", "_text"), _char_sets(chars), num, den, sketch=False)
    parts = cut(parts.join(texts.select("_key", "_rest"), parts["node"] == texts["_key"]).select(F.col("node").alias("_line"), "_rest", "component"), "line-components")
    discard(linked, texts)
    # a part is (component, 0), or a line of its own by its whole digest
    every = occurrences(docs, key, text).join(parts, ["_line", "_rest"], "left")
    every = every.select("_key", "line", F.struct(F.coalesce("component", "_line").alias("a"), F.when(F.col("component").isNull(), F.col("_rest").bitwiseOR(F.lit(1))).otherwise(0).alias("b")).alias("_part"))
    every = cut(every, "line-parts")
    first = cut(every.groupBy("_part").agg(F.min(F.struct("_key", "line")).alias("_first"), F.count("*").alias("_n")), "line-firsts")
    out = join_one(every, first, "_part")
    return out.select(F.col("_key").alias(key), "line", F.col("_first._key").alias("kept_key"), F.col("_first.line").alias("kept_line"), F.expr("_key = _first._key AND line = _first.line").alias("kept"))


def remove(df: DataFrame, found: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the lines that are not kept; rows of which no line with a word is left go, if they had one.
    found: what find() gave for df; key tells rows apart but for exact repeats. Nulls pass."""
    gone = found.where("NOT kept").groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set("line")).alias("_gone"))
    plain, (key_, text_) = hidden(df, key, text)
    rows = plain.join(gone, plain[key_] == F.col("_key"), "left").drop("_key")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts, gone = b.column(names.index(text_)), b.column(names.index("_gone"))
            kept, left = [], []
            for t, g in zip(texts, gone, strict=True):
                t, g = t.as_py(), g.as_py()
                if g is not None:
                    lines, dropped, number = [], set(g), 0
                    for line in t.split("\n"):
                        wordy = bool(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
                        if not (wordy and number in dropped):
                            lines.append(line)
                        number += wordy
                    t = "\n".join(lines)
                kept.append(g is None or number > len(dropped))
                left.append(t)
            columns = [pa.array(left, texts.type) if n == text_ else b.column(n) for n in names if n != "_gone"]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != "_gone"]).filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(strip, plain.schema).toDF(*df.columns)
