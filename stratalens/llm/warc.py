"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the end of each bundle holds the seek
table (compressed and decompressed size of every frame), as in the public seekable format. An index maps record ids
to (frame, offset within the frame), so one record costs one frame's read.

Bundles are rows of a table (archive, content, records) rather than local files: executors share no local folder,
and any store that Spark writes will do. A bundle has at most about bundle_bytes, so memory is bounded by one bundle
and the largest record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.cut import keyed

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "archive string, content binary, records array<struct<id: bigint, frame: int, offset: int, length: int>>"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, frame int, offset int"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record with the payload or, if refers_to, a revisit record of the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if "\x20" < c else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block, and the end of the record that starts at at."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    return fields, data[end + 4 : end + 4 + size], end + 4 + size + 4


class Bundle:
    """Gathers records into frames, and frames into a seekable bundle."""

    def __init__(self, frame_bytes: int, level: int) -> None:
        self.frame_bytes, self.zip = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.body, self.frames, self.open, self.index = bytearray(), [], bytearray(), []

    def add(self, key: int, raw: bytes) -> None:
        self.index.append((key, len(self.frames), len(self.open), len(raw)))
        self.open += raw
        if len(self.open) >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.zip.compress(bytes(self.open))
            self.frames.append((len(packed), len(self.open)))
            self.body += packed
            self.open.clear()

    def close(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return bytes(self.body) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer."""
    n, described, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if described & 0x80 else 8
    at, frames = len(content) - 9 - width * n, []
    start = 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", content, at + width * i)
        frames.append((start, packed, plain))
        start += packed
    return frames


def frame(content: bytes, table: list[tuple[int, int, int]], number: int) -> bytes:
    start, packed, plain = table[number]
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=plain)


def revisits(df: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """(key, digest, refers_to) of rows whose payload, of at least least bytes, a row with a larger key has too.

    Only digests move. The groups are added up before the shuffle, so a payload that a third of the rows share is
    one row of the groups.
    """
    small = df.select(F.col(key).alias("_key"), F.sha1(F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).alias("_digest"), F.coalesce(F.octet_length(payload), F.lit(0)).alias("_n")).where(F.col("_n") >= least)
    groups = small.groupBy("_digest").agg(F.max("_key").alias("refers_to"), F.min("_key").alias("_low")).where("_low < refers_to").drop("_low")
    return small.join(groups, "_digest").where("_key < refers_to").groupBy("_key", "_digest").agg(F.max("refers_to").alias("refers_to"))


def write(df: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "2025-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Bundles (BUNDLES) of one record per row of df.

    Null payloads are empty ones; null urls leave the target out; other columns are not read. Of rows with equal
    payloads that with the largest key is the response (all its copies, if its row repeats), the others revisit it.
    A key must be an integer (another type is an error at once); rows without one name no record and give none.
    An empty table gives no bundles.
    """
    src = keyed(df, key).select(F.col(key).cast("bigint").alias("_key"), F.col(url).cast("string").alias("_url"), F.col(payload).cast("binary").alias("_payload"))
    again = revisits(src, "_key", "_payload", least)
    digest = F.sha1(F.coalesce("_payload", F.lit(b"")))
    rows = src.withColumn("_digest", digest).join(again, ["_key", "_digest"], "left").select("_key", "_url", "_payload", "refers_to")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        out = Bundle(frame_bytes, level)

        def done() -> pa.RecordBatch:
            index = [{"id": k, "frame": f, "offset": o, "length": n} for k, f, o, n in out.index]
            kind = pa.list_(pa.struct([("id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:05d}"]), pa.array([out.close()], pa.binary()), pa.array([index], kind)], ["archive", "content", "records"])

        for b in batches:
            for k, u, p, r in zip(*b.columns, strict=True):
                out.add(k.as_py(), record(k.as_py(), u.as_py(), p.as_py() or b"", r.as_py(), date))
                if len(out.body) >= bundle_bytes:
                    yield done()
                    made += 1
                    out = Bundle(frame_bytes, level)
        if out.index:
            yield done()

    return rows.mapInArrow(bundle, BUNDLES)


def read(bundles: DataFrame) -> DataFrame:
    """Records (RECORDS) of bundles: frames are found by the seek table, responses' digests are computed anew."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
        for b in batches:
            for i in range(len(b)):
                name, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                table, rows = seek_table(content), []
                for number in range(len(table)):
                    data, at = frame(content, table, number), 0
                    while at < len(data):
                        fields, block, end = parse(data, at)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = fields["warc-type"]
                        if kind == "response":
                            size, digest, target = len(payload), payload_digest(payload), None
                        else:
                            size = int(http.decode().lower().split("content-length: ")[1].split("\r\n")[0])
                            digest, target = fields["warc-payload-digest"].partition(":")[2], int(fields["warc-refers-to"][10:-1])
                        rows.append((int(fields["warc-record-id"][10:-1]), size, digest, kind, target, name, number, at))
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return bundles.select("archive", "content").mapInArrow(records, RECORDS)


def fetch(bundles: DataFrame, wanted: DataFrame, key: str = "page_id") -> DataFrame:
    """(id, record) of the wanted ids: each costs the read of its one frame, at its offset there."""
    ids = wanted.select(F.col(key).cast("bigint").alias("id")).distinct()
    places = bundles.select("archive", F.explode("records").alias("r")).select("archive", "r.*").join(ids, "id", "left_semi")
    asked = places.groupBy("archive").agg(F.collect_list(F.struct("id", "frame", "offset", "length")).alias("places"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                content, found = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                table, rows = seek_table(content), []
                for number in sorted({p["frame"] for p in found}):
                    data = frame(content, table, number)
                    rows += [(p["id"], data[p["offset"] : p["offset"] + p["length"]]) for p in found if p["frame"] == number]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "record"])

    return bundles.join(asked, "archive").select("content", "places").mapInArrow(pick, "id bigint, record binary")
