"""Vectorised text kernels: numpy over the bytes of Arrow string columns, a few MB at a time.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r. UTF-8 never uses those bytes inside a longer
character, so byte positions and characters agree on where words start and end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 256 << 10  # arrays of eight bytes a character stay in the processor's cache

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PRIME, _PRIME_BASE = np.uint64((1 << 31) - 1), 1_103_515_247
LONG = 512  # bytes of a span from which on its hash has a second part
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them."""
    table = _POWERS.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, 1024), base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 4 * SLICE_BYTES:
            _POWERS[name] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows with at most limit bytes, or of one longer row.

    Nulls count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row offsets in words."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~_SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every line with a word, and the row offsets in lines. Lines are split at \\n alone."""
    newline = np.flatnonzero(data == 0x0A)
    starts = np.union1d(newline + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    if not len(starts):
        return starts, starts, np.zeros(len(offsets), np.int64)
    row_ends = offsets[np.searchsorted(offsets, starts, "right")]
    ends = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, starts)], row_ends)
    # the newline that a line ends with, and bytes between rows, are white space or belong to no other line
    wordy = np.logical_or.reduceat(~_SPACE[data], starts)
    starts, ends = starts[wordy], ends[wordy]
    return starts, ends, np.searchsorted(starts, offsets)


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, once each. For rows of some hundred values np.unique takes several times as long."""
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def found_in(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which values of x are in y; both are sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def common(x: set | np.ndarray, y: set | np.ndarray) -> int:
    """How many members two sets share, each a set or distinct sorted numbers; numbers beside a set stand for strings of
    eight characters, little-endian, of a byte each."""
    if isinstance(x, np.ndarray) and isinstance(y, np.ndarray):
        return int(found_in(y, x).sum())
    x, y = ({v.to_bytes(8, "little").decode("latin-1") for v in z.tolist()} if isinstance(z, np.ndarray) else z for z in (x, y))
    return len(x & y)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.where(data - np.uint8(0x41) < 26, data + np.uint8(0x20), data)


def _modular(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1."""
    for _ in range(2):
        x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _prime_powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo the prime, at least n of them."""
    table = _POWERS.get(f"prime {base}")
    if table is None or len(table) < n:
        table = np.ones(1, np.uint64)
        while len(table) < n:
            table = np.concatenate([table, _modular(table * np.uint64(pow(base, len(table), int(_PRIME))))])
        if n <= 4 * SLICE_BYTES:
            _POWERS[f"prime {base}"] = table
    return table


def _prime_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials modulo the prime over spans of values under 2**9."""
    n = len(values)
    up, down = _prime_powers(_PRIME_BASE, n + 1), _prime_powers(pow(_PRIME_BASE, -1, int(_PRIME)), n + 1)
    total = np.zeros(n + 1, np.uint64)
    for at in range(0, n, 1 << 22):  # sums stay under 2**64
        end = min(n, at + (1 << 22))
        total[at + 1 : end + 1] = _modular(np.cumsum(values[at:end] * up[at:end]) + total[at])
    return _modular(_modular(total[ends] + _PRIME - total[starts]) * down[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans, equal hashes. They find candidates; what must not be wrong is decided
    by digests() or by the bytes.

    A polynomial modulo 2**64 has pairs of long texts that collide for every base (of the Thue-Morse pattern, from
    some 1000 bytes on), so spans of LONG bytes or more take in a polynomial modulo a prime, too.
    """
    n = len(data)
    values = (_LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    long = np.flatnonzero(ends - starts >= LONG)
    if len(long):
        first, last = starts[long].min(), ends[long].max()
        more = _prime_hashes(values[first:last], starts[long] - first, ends[long] - first)
    values *= _powers("up", _BASE, n + 1)[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    h = total[ends] - total[starts]
    h *= _powers("down", _INVERSE, n + 1)[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if len(long):
        h[long] += mix(more)
    return mix(h)


def digests(raw: bytes, starts: Sequence[int], ends: Sequence[int]) -> np.ndarray:
    """128-bit digests of byte spans, as two rows of 64-bit numbers: what tells texts apart."""
    out = b"".join([blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts, ends, strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2).T


def word_digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """digests() of each row's words, A-Z lower-cased and parted by one space: equal for equal sequences of words only."""
    starts, _, rows = words(data, offsets)
    text, take = _LOWER[data], ~_SPACE[data]
    gaps = np.delete(starts, rows[:-1][np.diff(rows) > 0]) - 1
    text[gaps], take[gaps] = 0x20, True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(take, out=at[1:])
    at = at[offsets]
    return digests(text[take].tobytes(), at[:-1].tolist(), at[1:].tolist())


def windows(hashes: np.ndarray, row_offsets: np.ndarray, size: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of size items within a row, and the row offsets among them.

    whole_if_short: a row with fewer items, but some, has its whole sequence as its one run.
    """
    n = len(hashes)
    counts = np.diff(row_offsets)
    runs = np.maximum(counts - size + 1, 0)
    if n >= size:
        value = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            value *= np.uint64(0x100000001B3)
            value += hashes[i : n - size + 1 + i]
        rows = np.repeat(np.arange(len(counts)), runs)
        first = np.cumsum(runs) - runs
        at = np.arange(len(rows)) - np.repeat(first, runs) + np.repeat(row_offsets[:-1], runs)
        out = mix(value[at])
    else:
        out = np.zeros(0, np.uint64)
    if whole_if_short and (short := np.flatnonzero((counts > 0) & (counts < size))).size:
        extra = np.empty(len(short), np.uint64)
        for j, row in enumerate(short):
            value = np.uint64(counts[row])
            with np.errstate(over="ignore"):
                for h in hashes[row_offsets[row] : row_offsets[row + 1]]:
                    value = value * np.uint64(0x100000001B3) + h
            extra[j] = value
        extra = mix(extra ^ np.uint64(0x5851F42D4C957F2D))
        put = np.cumsum(runs)[short]
        out = np.insert(out, put, extra)
        runs[short] = 1
    return out, np.concatenate([[0], np.cumsum(runs)])


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text."""
    out = np.zeros(len(column), np.int64)
    for a, b, data, offsets in text_slices(column):
        out[a:b] = np.diff(words(data, offsets)[2])
    return out
