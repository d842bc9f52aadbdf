"""TIFF media columns: read image files held in binary columns, one row per page, and write them.

Reading walks the chain of image directories, takes strips or tiles, undoes PackBits, LZW or deflate, undoes the
horizontal predictor, and lays tiles out on the page. Both byte orders are read. Samples are of 1, 8 or 16 bits (1-bit
samples come out as bytes 0 and 1, 16-bit samples little-endian), chunky or planar; pages of anything else give a row
with an error, as do files that are damaged, empty or null, and pages that claim more samples than their strips can
hold or than MOST_BYTES: a bad file never fails the job.

Pages are decoded one at a time, so memory is bounded by one file and one of its pages. PackBits is undone packet by
packet and LZW code by code (codes are cut out of the bits by numpy, a table's worth at a time).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags, field types and compression schemes of TIFF 6.0.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
CODECS = {"none": NONE, "lzw": LZW, "deflate": ADOBE_DEFLATE, "packbits": PACKBITS}
_FIELD = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i")}

MOST_BYTES = 1 << 30  # of a page
#: Bytes that a stored byte of each scheme gives at most.
_GROWTH = {NONE: 1, PACKBITS: 64, ADOBE_DEFLATE: 1040, DEFLATE: 1040, LZW: 2740}

PAGE = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("compression", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType()),
])


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 3 or more equal bytes as (257 - n, byte), other stretches as (n - 1, bytes)."""
    values = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(values)))
    out, literal = bytearray(), 0

    def stretch(end: int) -> None:
        for i in range(literal, end, 128):
            piece = data[i : min(end, i + 128)]
            out.append(len(piece) - 1)
            out.extend(piece)

    long = sizes >= 3
    for at, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
        stretch(at)
        literal = at + n
        while n > 1:
            some = min(n, 128)
            out += bytes([257 - some, data[at]])
            n -= some
        literal -= n  # a single byte that is left over goes with the next stretch
    stretch(len(data))
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128 and at + 1 < len(data):
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bit on, 256 clears, 257 ends, and widths grow one code early."""
    acc = held = 0
    out = bytearray()
    table, width = {}, 9

    def put(code: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    put(256)
    fresh, known = 258, -1
    for byte in data:
        if known < 0:
            known = byte
            continue
        longer = table.get(known << 8 | byte)
        if longer is not None:
            known = longer
            continue
        put(known)
        table[known << 8 | byte] = fresh
        fresh += 1
        known = byte
        if fresh == 4094:
            put(256)
            table, width, fresh = {}, 9, 258
        elif fresh == 1 << width:
            width += 1
    if known >= 0:
        put(known)
        fresh += 1
        if fresh >= 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(acc << 8 - held & 255)
    return bytes(out)


#: Bits before the n-th code after a clear, and its width: widths grow one code early, and stay at 12.
_CODE_BITS = np.array([min(12, max(9, (258 + n).bit_length())) for n in range(4096)])
_CODE_AT = np.concatenate([[0], np.cumsum(_CODE_BITS)])


def lzw_decode(data: bytes) -> bytes:
    """Every code after the first repeats what an earlier code gave and the byte that followed it, so entries are
    places in the output."""
    stored = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.uint32)
    bit, total = 0, 8 * len(data)
    out = bytearray()
    while bit + 9 <= total:
        at = bit + _CODE_AT[:-1]
        at = at[at + _CODE_BITS <= total]
        byte = at >> 3
        word = stored[byte] << 24 | stored[byte + 1] << 16 | stored[byte + 2] << 8 | stored[byte + 3]
        codes = word >> (32 - (at & 7) - _CODE_BITS[: len(at)]).astype(np.uint32) & ((1 << _CODE_BITS[: len(at)]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stops[0]) if len(stops) else len(codes)
        places: list[int] = []  # of what each code gave
        for entries, code in enumerate(codes[:n].tolist()):
            here = len(out)
            places.append(here)
            if code < 256:
                out.append(code)
            elif 258 <= code < 258 + entries:
                start, end = places[code - 258], places[code - 257] + 1
                if end <= here:
                    out += out[start:end]
                else:  # the entry's last byte is its own first
                    out += out[start:here]
                    out.append(out[here])
            else:
                raise ValueError("LZW code is not set")
        if n == len(codes) or codes[n] == 257:
            break
        bit = int(at[n]) + int(_CODE_BITS[n])
    return bytes(out)


def _encode(block: np.ndarray, codec: str, predictor: bool) -> bytes:
    """A strip or tile (rows, columns, samples) of 8-bit samples."""
    if predictor:
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
    raw = block.tobytes()
    if codec == "deflate":
        return zlib.compress(raw, 1)
    if codec == "lzw":
        return lzw_encode(raw)
    if codec == "packbits":
        return b"".join(pack_bits(row.tobytes()) for row in block)
    return raw


def _decode(raw: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = raw
    elif compression in (ADOBE_DEFLATE, DEFLATE):
        out = zlib.decompressobj().decompress(raw, size)
    elif compression == LZW:
        out = lzw_decode(raw)
    elif compression == PACKBITS:
        out = unpack_bits(raw)
    else:
        raise ValueError(f"compression {compression} is not read")
    if len(out) < size:
        raise ValueError(f"a strip or tile has {len(out)} of {size} bytes")
    return out[:size]


def write(pages: list[np.ndarray], codec: str = "deflate", predictor: bool = True, rows_per_strip: int = 1024, tile: int = 0) -> bytes:
    """A little-endian TIFF of pages (height, width[, samples]) of 8-bit samples, in strips or, if tile, in tiles."""
    body, directories = bytearray(8), []
    for page in pages:
        page = page.reshape(*page.shape[:2], -1)
        height, width, samples = page.shape
        blocks = []
        if tile:
            for top in range(0, height, tile):
                for left in range(0, width, tile):
                    part = page[top : top + tile, left : left + tile]
                    blocks.append(np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)), mode="edge"))
        else:
            blocks = [page[top : top + rows_per_strip] for top in range(0, height, rows_per_strip)]
        at, sizes = [], []
        for block in blocks:
            raw = _encode(block, codec, predictor)
            at.append(len(body))
            sizes.append(len(raw))
            body += raw
            body += b"\0" * (len(body) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [CODECS[codec]]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, at), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        fields += [(PREDICTOR, 3, [2])] if predictor else []
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{_FIELD[kind][1]}", *values)
            if len(packed) > 4:
                where = len(body)
                body += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        directories.append(len(body))
        body += struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"
    body[:8] = struct.pack("<2sHI", b"II", 42, directories[0] if directories else 0)
    for here, following in zip(directories, directories[1:], strict=False):
        n = struct.unpack_from("<H", body, here)[0]
        struct.pack_into("<I", body, here + 2 + 12 * n, following)
    return bytes(body)


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in _FIELD:
            size, code = _FIELD[kind]
            where = at + 10 + 12 * i
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            found[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, f: dict[int, tuple], order: str) -> tuple[int, int, int, int, int, bytes]:
    width, height, samples = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
    bits = set(f.get(BITS, (1,)))
    compression, predictor, planar = f.get(COMPRESSION, (NONE,))[0], f.get(PREDICTOR, (1,))[0], f.get(PLANAR, (1,))[0]
    if bits not in ({1}, {8}, {16}) or predictor not in (1, 2) or bits == {1} and (predictor == 2 or samples != 1):
        raise ValueError("only 8-bit and 16-bit samples, single 1-bit ones, and predictors 1 and 2, are read")
    if compression not in _GROWTH:
        raise ValueError(f"compression {compression} is not read")
    depth = bits.pop()
    kind = np.dtype(order + "u2") if depth == 16 else np.dtype(np.uint8)
    planes, inside = (samples, 1) if planar == 2 else (1, samples)
    if TILE_AT in f:
        wide, high, at, sizes = f[TILE_WIDTH][0], f[TILE_HEIGHT][0], f[TILE_AT], f[TILE_BYTES]
    else:
        wide, high, at, sizes = width, min(f.get(ROWS_PER_STRIP, (height,))[0], height), f[STRIP_AT], f[STRIP_BYTES]
    if min(width, height, samples, wide, high) < 1:
        raise ValueError("a page, strip or tile without a sample")
    across, down = -(-width // wide), -(-height // high)
    if min(len(at), len(sizes)) < planes * across * down:
        raise ValueError("strips or tiles are missing")
    size = width * height * samples * kind.itemsize
    held = sum(min(max(0, n), len(data)) for n in sizes[: planes * across * down]) * _GROWTH[compression]
    stride = -(-wide // 8) if depth == 1 else wide * inside * kind.itemsize
    if size > MOST_BYTES or size > held * (8 if depth == 1 else 1) or high * stride > MOST_BYTES:
        raise ValueError(f"{size} bytes of samples are more than {held} that the strips can hold, or than is read")
    out = np.zeros((height, width, samples), kind.newbyteorder("<"))
    for i in range(planes * across * down):
        plane, rest = divmod(i, across * down)
        top, left = rest // across * high, rest % across * wide
        rows = high if TILE_AT in f else min(high, height - top)
        block = np.frombuffer(_decode(data[at[i] : at[i] + sizes[i]], compression, rows * stride), kind)
        block = np.unpackbits(block.reshape(rows, stride), axis=1)[:, :wide, None] if depth == 1 else block.reshape(rows, wide, inside)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        part = block[: height - top, : width - left]
        if planar == 2:
            out[top : top + rows, left : left + wide, plane] = part[:, :, 0]
        else:
            out[top : top + rows, left : left + wide] = part
    return width, height, samples, depth, compression, out.tobytes()


def read(data: bytes | None) -> Iterator[tuple]:
    """Rows (page, width, height, samples, bits, compression, pixels, error) of a file; directories met twice end it."""
    none = (None,) * 6
    if not data:
        yield (0, *none, "no file")
        return
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    try:
        if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF")
        (at,) = struct.unpack_from(order + "I", data, 4)
    except (ValueError, struct.error) as e:
        yield (0, *none, str(e))
        return
    seen: set[int] = set()
    page = 0
    while at and at not in seen:
        seen.add(at)
        try:
            fields, at = _fields(data, at, order)
        except (struct.error, MemoryError) as e:
            yield (page, *none, f"broken directory: {e}")
            return
        try:
            yield (page, *_page(data, fields, order), None)
        except (KeyError, ValueError, struct.error, zlib.error, IndexError, OverflowError, MemoryError) as e:
            yield (page, *none, f"{type(e).__name__}: {e}")
        page += 1


def feature(pixels: bytes, width: int) -> str:
    """What a page of 8-bit samples looks like: mean and deviation of its samples, mean step to the right and down,
    entropy in bits, and the shares of eight bands of values, in thousandths."""
    samples = np.frombuffer(pixels, np.uint8)
    image = samples[: len(samples) // width * width].reshape(-1, width).astype(np.int16)
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    mean = int(counts @ values) / n
    deviation = (int(counts @ (values * values)) / n - mean * mean) ** 0.5
    steps = [int(np.abs(d).sum(dtype=np.int64)) / max(1, d.size) for d in (np.diff(image, axis=1), np.diff(image, axis=0))]
    share = counts[counts > 0] / n
    bands = counts.reshape(8, 32).sum(axis=1) * 1000 // n
    return f"mean {mean:.2f} deviation {deviation:.2f} right {steps[0]:.2f} down {steps[1]:.2f} entropy {-(share * np.log2(share)).sum():.3f} bands {','.join(map(str, bands.tolist()))}"


def pages(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """One row per page of the files in a binary column: the columns keep, those of PAGE, and feature (see feature();
    null if the page's samples are not of 8 bits).

    A kept column that is named like one of these comes out with file_ before its name. Null, empty and damaged files
    give one row with an error. Rows that repeat repeat their pages. An empty table gives no rows.
    """
    taken = {*PAGE.fieldNames(), "feature"}
    src = df.select(*[F.col(c).alias(f"file_{c}" if c in taken else c) for c in keep], F.col(content).alias("_file"))
    schema = T.StructType([*src.schema.fields[:-1], *PAGE.fields, T.StructField("feature", T.StringType())])
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string(), pa.string()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(source: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
            kept = source.take(pa.array(rows, pa.int64())).columns[:-1]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([*kept, *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

        for b in batches:
            rows, out, held = [], [], 0
            files = b.column(len(keep))
            for i in range(len(b)):
                for page in read(files[i].as_py()):
                    rows.append(i)
                    out.append((*page, feature(page[6], page[1] * page[3]) if page[4] == 8 else None))
                    held += len(page[6] or b"")
                    if held > 8 << 20:
                        yield batch(b, rows, out)
                        rows, out, held = [], [], 0
            yield batch(b, rows, out)

    return src.mapInArrow(decode, schema)


def from_texts(df: DataFrame, text: str, keep: list[str], width: int = 576, codec: str = "deflate") -> DataFrame:
    """Whole texts as one-page grey TIFFs, losslessly: keep, n_bytes (unpadded) and file.

    A text's UTF-8 bytes (null: none), then bytes 255 up to a positive multiple of width, are rows of 8-bit samples.
    Rows that repeat repeat their files; an empty table gives no rows.
    """
    src = df.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("file", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(source: pa.RecordBatch, a: int, sizes: list[int], files: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*source.slice(a, len(files)).columns[:-1], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], schema.names)

        for b in batches:
            sizes, files, held, a = [], [], 0, 0
            texts = b.column(len(keep))
            for i in range(len(b)):
                raw = texts[i].as_py() or b""
                padded = raw + b"\xff" * (-len(raw) % width or (width if not raw else 0))
                files.append(write([np.frombuffer(padded, np.uint8).reshape(-1, width)], codec))
                sizes.append(len(raw))
                held += len(files[-1])
                if held > 8 << 20:
                    yield batch(b, a, sizes, files)
                    sizes, files, held, a = [], [], 0, i + 1
            yield batch(b, a, sizes, files)

    return src.mapInArrow(encode, schema)
