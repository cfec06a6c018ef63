"""WARC archives in seekable Zstandard bundles.

A bundle groups records into independent Zstandard frames and ends with a seek table in a skippable frame: the
compressed and decompressed size of each frame, so any standard decompressor reads the bundle as one
WARC file and a reader of one record decompresses one frame. An index maps a record's id to its bundle,
frame and place in the frame.

Of records with equal payloads (of at least ``SHARED`` bytes) one is a response, the others are revisits
that refer to it. Payloads that occur once move through no shuffle; of the others each task sends one copy, however many pages have it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import bitmap_of, bits_for, in_bitmap, scratch, stored

#: Smallest payload that is stored once; record bytes and records in a frame; frames in a bundle.
SHARED, FRAME_BYTES, FRAME_RECORDS, BUNDLE_FRAMES = 1000, 1 << 18, 64, 4096
#: Most bits of the bitmap of digests that occur again.
MOST_BITS = 26
#: Fixed values of the format: skippable frame, footer, and an end of header.
SKIPPABLE, SEEKABLE, BREAK = 0x184D2A5E, 0x8F92EAB1, b"\r\n"
#: The date of the records written here; archives of equal pages are then equal.
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if refers_to is not None else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BREAK * 2 + block + BREAK * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of one record."""
    head, _, rest = data.partition(BREAK * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != BREAK * 2:
        raise ValueError("a record's length does not match its header")
    return fields, block


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame behind the last frame: sizes of every frame, then a footer of nine bytes."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame of a bundle."""
    end = source.size()
    count, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
    if magic != SEEKABLE or flags:
        raise ValueError("not a bundle with a plain seek table")
    entries = struct.iter_unpack("<II", source.read_at(8 * count, end - 9 - 8 * count))
    out, at = [], 0
    for packed, size in entries:
        out.append((at, packed, size))
        at += packed
    return out


class BundleWriter:
    """Writes records into bundles of a folder; gives each record's place."""

    def __init__(self, folder: str) -> None:
        self.filesystem, self.path = fs.FileSystem.from_uri(folder)
        self.filesystem.create_dir(self.path, recursive=True)
        self.name, self.sink, self.frames = "", None, []
        self.held, self.size, self.count = [], 0, 0
        self.pack = zstandard.ZstdCompressor(level=6, write_content_size=True)

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        """(bundle, frame, place in the frame, length)."""
        if self.held and (self.size + len(data) > FRAME_BYTES or len(self.held) >= FRAME_RECORDS):
            self._end_frame()
        if self.sink is not None and len(self.frames) >= BUNDLE_FRAMES:
            self.close()
        if self.sink is None:
            self.name, self.frames = f"{uuid.uuid4().hex}.warc.zst", []
            self.sink = self.filesystem.open_output_stream(f"{self.path}/{self.name}", compression=None)
        place = (self.name, len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        return place

    def _end_frame(self) -> None:
        frame = self.pack.compress(b"".join(self.held))
        self.sink.write(frame)
        self.frames.append((len(frame), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.sink is not None:
            if self.held:
                self._end_frame()
            self.sink.write(seek_table(self.frames))
            self.sink.close()
            self.sink = None


def with_types(pages: DataFrame) -> tuple[DataFrame, bytes]:
    """(rows, bitmap): page_id, url, html, digest, refers_to (the page that holds the payload, null for responses) and place.

    A row whose place has its bit set in the bitmap stands for a payload that may occur again; such pages come a second time, without a
    place, with their type: these count, and revisits have no html. The response is the row with the largest page_id; rows that share
    that id and payload are all responses. Rows with a null page_id are responses and nothing refers to them.
    """
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha1(data).alias("digest"), (F.octet_length(data) >= SHARED).alias("large"))
    again = stored(pages.where("large").groupBy("digest").count().where("count > 1").select("digest"), "repeated-digests")
    bits = bits_for(again.count(), MOST_BITS)
    place = F.pmod(F.xxhash64("digest"), F.lit(1 << bits))
    bitmap = bitmap_of(again, place, bits)
    every = pages.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"), F.when(F.col("large"), place).alias("place"))
    if again.isEmpty():
        return every, bitmap
    shared = pages.where("large").where(in_bitmap(bitmap, place))
    # per digest the largest id and one copy of the payload, both found before rows move
    held = stored(shared.groupBy("digest").agg(F.max("page_id").alias("top"), F.max("html").alias("html")), "shared-payloads")
    named = stored(shared.select("page_id", "url", "digest").join(held.select("digest", "top"), "digest"), "shared-pages")
    revisit = F.coalesce(F.col("page_id") < F.col("top"), F.lit(False))
    revisits = named.where(revisit).select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", F.col("top").alias("refers_to"))
    responses = named.where(~revisit).drop("top").join(held.select("digest", "html"), "digest").withColumn("refers_to", F.lit(None).cast("long"))
    return every.unionByName(revisits.unionByName(responses).withColumn("place", F.lit(None).cast("long"))), bitmap


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row; the index (name, bundle, frame, start, length) as a scratch table."""
    rows, bitmap = with_types(pages.select("page_id", "url", "html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder)
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            out: list[tuple] = []
            for page, url, html, digest, top, place in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "place")), strict=True):
                if place is not None and bitmap[place >> 3] >> (place & 7) & 1:
                    continue
                payload = (html or "").encode()
                kind = "response" if top is None else "revisit"
                name = f"urn:page:{'' if page is None else page}"
                out.append((name, *writer.add(record(kind, name, url, payload, digest, None if top is None else f"urn:page:{top}"))))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "bundle", "frame", "start", "length"])
        writer.close()

    return stored(rows.mapInArrow(work, "name string, bundle string, frame long, start long, length long"), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(name, kind, digest, payload_bytes, refers_to) of every record of the index.

    A response's digest is that of the block as read; it must agree with the header.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        now, source, table, frame_at, frame = None, None, [], -1, b""
        for batch in batches:
            out: list[tuple] = []
            for name, bundle, at, start, length in zip(*(batch.column(c).to_pylist() for c in ("name", "bundle", "frame", "start", "length")), strict=True):
                if bundle != now:
                    if source is not None:
                        source.close()
                    source = filesystem.open_input_file(f"{path}/{bundle}")
                    now, table, frame_at = bundle, read_seek_table(source), -1
                if at != frame_at:
                    first, packed, size = table[at]
                    frame_at, frame = at, unpack.decompress(source.read_at(packed, first), max_output_size=size)
                fields, block = parse(frame[start : start + length])
                if fields["WARC-Record-ID"] != f"<{name}>":
                    raise ValueError(f"the index does not lead to {name}")
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"the payload of {name} does not match its digest")
                refers = fields.get("WARC-Refers-To")
                out.append((name, kind, digest, len(block) if kind == "response" else None, refers and refers.strip("<>")))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "kind", "digest", "payload_bytes", "refers_to"])

    rows = index.repartition("bundle", F.floor(F.col("frame") / 64)).sortWithinPartitions("bundle", "frame", "start")
    return rows.mapInArrow(work, "name string, kind string, digest string, payload_bytes long, refers_to string")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A revisit's payload size is that of the record it refers to. Null html is an empty payload, a null url
    leaves the header out. Repeated rows each have a record. An empty table writes nothing and gives an empty result;
    other columns are ignored.
    """
    folder = scratch(pages.sparkSession, "warc")
    records = stored(read_archives(write_archives(pages, folder), folder), "records")
    revisits = records.where("kind = 'revisit'").drop("payload_bytes")
    named = revisits.select(F.col("refers_to").alias("name")).distinct()
    targets = records.where("kind = 'response'").join(named, "name", "left_semi").groupBy(F.col("name").alias("target"), F.col("digest").alias("same")).agg(F.max("payload_bytes").alias("payload_bytes"))
    both = revisits.join(targets, (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("same")), "left").select(*records.columns)
    page = lambda c: F.expr(f"try_cast(nullif(substring({c}, 10), '') as bigint)")
    out = records.where("kind = 'response'").unionByName(both)
    return out.select(page("name").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))
