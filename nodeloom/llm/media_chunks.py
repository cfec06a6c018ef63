"""Media columns: payloads cut at content-defined places, stored once per distinct chunk.

A rolling gear hash over the last 32 bytes cuts a payload where its low bits are zero (between ``LEAST`` and
``MOST`` bytes apart), so equal passages become equal chunks wherever they stand. Spark groups the chunk digests of
all payloads. A chunk that occurs once goes into the pack file of the task that cuts it, as a Zstandard frame; the frames
of chunks that may occur again are grouped by digest, each is written once, and a join over digests gives its place. The
ordered list of places is a payload's recipe. Reading follows recipes, checks every chunk against its digest and
rebuilds the payload.

The stored form of a payload is the row of its chunks' frames in order. Chunks that occur once move through no
shuffle; of the others a task sends each one about once, however often it has it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import bitmap_of, bits_for, scratch, sized, stored

#: Shortest chunk, bits that are zero at a cut, longest chunk, payload unit and pad byte.
LEAST, ZERO_BITS, MOST, UNIT, PAD = 512, 11, 16384, 576, b"\xff"
#: Chunks kept while reading, in bytes; digests whose frame a task has sent that it remembers (it sends one that it forgot again);
#: most bits of the bitmap of digests that occur again.
CACHE, REMEMBERED, MOST_BITS = 32 << 20, 50_000, 26
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)


def padded(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """(payload, length without padding): UTF-8 with bytes 255 up to a positive multiple of ``unit``."""
    data = text.encode() if text else b""
    return data + PAD * (-len(data) % unit if data else unit), len(data)


def cut_points(payload: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    rolled = _GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the sum over the last 2k bytes, each shifted by its distance
        rolled[k:] += rolled[:-k] << np.uint32(k)
    places = np.flatnonzero((rolled & np.uint32(((1 << ZERO_BITS) - 1) << (32 - ZERO_BITS))) == 0) + 1
    ends, at, i = [], 0, 0
    places = places.tolist()
    while n - at > LEAST:
        while i < len(places) and places[i] < at + LEAST:
            i += 1
        end = min(places[i] if i < len(places) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def repeated_chunks(payloads: DataFrame) -> tuple[bytes, int]:
    """(bitmap, bits) of the keys of the digests that occur more than once; other digests may share a bit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            keys = []
            for text in batch.column(0).to_pylist():
                payload, lo = padded(text)[0], 0
                for hi in cut_points(payload):
                    keys.append(_key(hashlib.sha256(payload[lo:hi]).digest()))
                    lo = hi
            yield pa.record_batch([pa.array(keys, pa.int64())], ["key"])

    found = payloads.select("text").mapInArrow(work, "key long").groupBy("key").count().where("count > 1").select("key")
    found = stored(found, "repeated-chunks")
    bits = bits_for(found.count(), MOST_BITS)
    return bitmap_of(found, F.col("key").bitwiseAND(F.lit((1 << bits) - 1)), bits), bits


def write_packs(payloads: DataFrame, folder: str) -> DataFrame:
    """Store the chunks of rows (id, text) that occur once; a scratch table (pack, row, id, n_bytes, seq, digest, start, length, frame).

    start is null for a chunk that may occur again; one row of each such digest in each task has its frame. A task that runs
    again writes a pack of another name; only packs named in the table count.
    """
    bitmap, bits = repeated_chunks(payloads)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(path, recursive=True)
        name, at, row, mask = uuid.uuid4().hex, 0, 0, (1 << bits) - 1
        sent: OrderedDict[bytes, None] = OrderedDict()
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        with filesystem.open_output_stream(f"{path}/{name}") as sink:
            for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
                out: dict[str, list] = {k: [] for k in ("row", "id", "n_bytes", "seq", "digest", "start", "length", "frame")}
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    payload, size = padded(text)
                    lo = 0
                    for seq, hi in enumerate(cut_points(payload)):
                        chunk = payload[lo:hi]
                        digest = hashlib.sha256(chunk).digest()
                        place = _key(digest) & mask
                        start = length = frame = None
                        if not bitmap[place >> 3] >> (place & 7) & 1:
                            packed = pack.compress(chunk)
                            sink.write(packed)
                            start, length = at, len(packed)
                            at += length
                        elif digest not in sent:
                            frame = pack.compress(chunk)
                            sent[digest] = None
                            if len(sent) > REMEMBERED:
                                sent.popitem(last=False)
                        for key, value in zip(out, (row, doc, size, seq, digest, start, length, frame), strict=True):
                            out[key].append(value)
                        lo = hi
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
                columns = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
                yield pa.record_batch([pa.array([name] * len(out["row"])), *columns], ["pack", *out])

    rows = payloads.select("id", "text").mapInArrow(work, "pack string, row long, id long, n_bytes long, seq int, digest binary, start long, length int, frame binary")
    return stored(rows, "chunks")


def write_shared(chunks: DataFrame, folder: str) -> DataFrame:
    """Write each frame that the chunks carry once; a scratch table (digest, at_pack, at_start, at_length)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(path, recursive=True)
        name, at = uuid.uuid4().hex, 0
        with filesystem.open_output_stream(f"{path}/{name}") as sink:
            for batch in batches:
                starts, sizes = [], []
                for frame in batch.column(1):
                    data = frame.as_buffer()
                    sink.write(data)
                    starts.append(at)
                    sizes.append(data.size)
                    at += data.size
                yield pa.record_batch([batch.column(0), pa.array([name] * len(sizes), pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32())], ["digest", "at_pack", "at_start", "at_length"])

    frames = chunks.where("frame is not null").groupBy("digest").agg(F.min("frame").alias("frame"))  # all frames of a digest are equal
    return stored(frames.mapInArrow(work, "digest binary, at_pack string, at_start long, at_length int"), "shared-chunks")


def recipes(chunks: DataFrame, shared: DataFrame) -> DataFrame:
    """(pack, row, id, n_bytes, seq, digest, at_pack, at_start, at_length): the one place of each chunk of each payload."""
    columns = ["pack", "row", "id", "n_bytes", "seq", "digest"]
    alone = chunks.where("start is not null").select(*columns, F.col("pack").alias("at_pack"), F.col("start").alias("at_start"), F.col("length").alias("at_length"))
    others = chunks.where("start is null").select(*columns).join(sized(shared), "digest")
    return alone.unionByName(others)


class PackReader:
    """Frames by place, with the last ones kept."""

    def __init__(self, folder: str) -> None:
        self.filesystem, self.path = fs.FileSystem.from_uri(folder)
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.kept: OrderedDict[tuple[str, int], bytes] = OrderedDict()
        self.size = 0

    def frame(self, pack: str, start: int, length: int) -> bytes:
        found = self.kept.get((pack, start))
        if found is None:
            if pack not in self.files:
                self.files[pack] = self.filesystem.open_input_file(f"{self.path}/{pack}")
                if len(self.files) > 64:
                    self.files.popitem(last=False)[1].close()
            self.files.move_to_end(pack)
            found = self.files[pack].read_at(length, start)
            self.kept[pack, start] = found
            self.size += length
            while self.size > CACHE:
                self.size -= len(self.kept.popitem(last=False)[1])
        else:
            self.kept.move_to_end((pack, start))
        return found


def byte_feature(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and the share of the commonest, to six digits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float((share * np.arange(256)).sum())
    spread = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"mean={mean:.6f};std={spread:.6f};entropy={entropy:.6f};top={share.max():.6f};n={len(payload)}"


def read_media(recipe: DataFrame, folder: str) -> DataFrame:
    """Rebuild every payload from the packs and measure it; a chunk that fails its digest is an error."""

    def measure(reader: PackReader, parts: list[tuple]) -> tuple:
        unpack = zstandard.ZstdDecompressor()
        payload, media, length, crc = hashlib.sha256(), hashlib.sha256(), 0, 0
        data = bytearray()
        for digest, pack, start, size in parts:
            frame = reader.frame(pack, start, size)
            chunk = unpack.decompress(frame)
            if hashlib.sha256(chunk).digest() != digest:
                raise ValueError(f"chunk at {pack}:{start} does not match its digest")
            media.update(frame)
            length += size
            data += chunk
        payload.update(data)
        crc = zlib.crc32(data[-32:])
        return len(data), payload.hexdigest(), crc, length, media.hexdigest(), byte_feature(bytes(data)), len(parts)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PackReader(folder)
        now, parts, out = None, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = [pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64() for k in names]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for pack, row, doc, size, digest, *place in zip(*(batch.column(c).to_pylist() for c in ("pack", "row", "id", "n_bytes", "digest", "at_pack", "at_start", "at_length")), strict=True):
                if now is None or now[:2] != (pack, row):
                    if now is not None:
                        out.append((*now[2:], *measure(reader, parts)))
                    now, parts = (pack, row, doc, size), []
                parts.append((digest, *place))
            yield flush()
            out = []
        if now is not None:
            out.append((*now[2:], *measure(reader, parts)))
            yield flush()

    # the payloads of a pack stay together, as their chunks mostly lie in it
    rows = recipe.repartition("pack").sortWithinPartitions("pack", "row", "seq")
    return rows.mapInArrow(work, schema)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the payload of every row in chunks, read it back and measure it: one row per row of docs.

    Null and empty texts are a payload of padding alone. Null and repeated ids are kept row by row, equal
    texts have equal values, an empty table gives an empty result, other columns are ignored.
    """
    folder = scratch(docs.sparkSession, "packs")
    chunks = write_packs(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), folder)
    return read_media(recipes(chunks, write_shared(chunks, folder)), folder).withColumnRenamed("id", id_col)
