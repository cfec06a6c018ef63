"""Token-ID output: Arrow IPC files of fixed-size-list batches, for zero-copy access to sequences.

All documents, in ascending id order, form one stream of ids; each range of ids is a shard. A shard is
an Arrow file of batches of ``ROWS`` sequences with two fixed-size-list columns, ``ids`` (uint16) and ``mask`` (one bit
each, false on the padding behind a shard's last id), and an Arrow file with the place of each document in it. Sequence k of a shard is row
``k % ROWS`` of batch ``k // ROWS``; a memory map gives its ids without a copy.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import scratch, stored, tidy
from nodeloom.llm.wordhash import distinct_words, spans

#: Ids in a sequence, sequences in a batch, words kept between batches.
LENGTH, ROWS, WORDS_KEPT = 2048, 256, 300_000
#: Text bytes encoded at once, and those whose words are looked up at once.
TEXT_SPAN, RUN = 4_000_000, 1 << 22
#: Rows of a batch taken out of Arrow at once.
BATCH = 2048


#: Marks that are parted from the letters and digits in front of them: all of ASCII but the apostrophe, which may belong to letters. Fixed values.
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, but for those in front of a character beyond ASCII: it may be a mark that the tokenizer composes with them first."""
    capital = (buf >= 65) & (buf <= 90)
    capital[:-1] &= buf[1:] < 128
    return buf | capital.astype(np.uint8) << 5


def parted(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a blank in front of each run of marks between a letter or digit and a blank or LF, and where texts begin then.

    Letters are a-z and those of two bytes that begin with 0xC3 (but the signs for times and divided by).
    """
    mark = _MARK[buf]
    edge = np.diff(mark.view(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inside = (starts > 1) & (stops < len(buf))
    starts, stops = starts[inside], stops[inside]
    one, two, behind = buf[starts - 1], buf[starts - 2], buf[stops]
    letter = _PLAIN[one] | ((two == 0xC3) & (one != 0x97) & (one != 0xB7))
    at = starts[letter & ((behind == 0x20) | (behind == 0x0A))]
    return np.insert(buf, at, 0x20), offsets + np.searchsorted(at, offsets)


#: Texts on which both ways of encoding must agree before words are looked up one by one.
PROBES = ("A. b.! c'd.e, F..", "one.\n\ntwo,\tThree;  four", "Straße ÀÉ naïve W\u030a H\u0331 J\u030c", "x\u00a0y\u2028z\u3000w", "a%%% b,&& c.) 9** é,, ü!! ×!! ÷? x'y, z', 'n'. e\u0308, =\u0338 a=\u0338 q- 1.-_ ß) ", "don't I'LL it's 123 4.5", "漢字かな 한국 ▁ 𝔘", "\x00 \x0b\x0c\r a", "a" * 300)


class WordEncoder:
    """Ids of texts by a tokenizer; words are looked up once and kept if it never joins what ASCII white space separates.

    That, and whether letters may be lower-cased first, is tried on PROBES with the tokenizer itself; otherwise it encodes whole texts.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the files hold ids of 16 bits")
        self.specials = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.by_words, self.lowers = True, False
        self.by_words = self._agrees()
        self.lowers = self.by_words
        self.lowers = self.by_words and self._agrees()
        self.known = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [found.ids for found in many(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint16) for ids in self._ids(texts)]

    def _agrees(self) -> bool:
        self.known = {}
        pairs = zip(self.encode(list(PROBES)), self._whole(list(PROBES)), strict=True)
        return all(np.array_equal(a, b) for a, b in pairs)

    def _learn(self, fresh: list[bytes]) -> None:
        for word in fresh:
            if (ids := self.before.get(word)) is not None:
                self.known[word] = ids
        fresh = [w for w in fresh if w not in self.known]
        for lo in range(0, len(fresh), 5_000):
            part = fresh[lo : lo + 5_000]
            found = self._ids([w.decode() for w in part])
            flat = array("H", itertools.chain.from_iterable(found)).tobytes()  # one array for all, cut where a word's ids end
            cuts = [0, *itertools.accumulate([2 * len(ids) for ids in found])]
            self.known.update(zip(part, map(flat.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; each distinct word of about ``RUN`` bytes of text is looked up once.

        A tokenizer that composes, then lower-cases all but its special tokens, and parts letters from marks, gives the same ids if A-Z that
        compose with nothing are lower-cased before and marks behind the last letter or digit of a word are looked up as a word of their own; where
        a special token can appear, the text stays as it is.
        """
        if not self.by_words:
            return [ids for lo in range(0, len(texts), 256) for ids in self._whole([t or "" for t in texts[lo : lo + 256]])]
        out: list[np.ndarray] = []
        for _, run in spans(texts, RUN):
            raw = b"\n".join(run) + b"\n"
            offsets = np.append(0, np.cumsum([len(x) + 1 for x in run]))
            if self.lowers and not any(token in low for low in [raw.lower()] for token in self.specials):
                buf, offsets = parted(lowered(np.frombuffer(raw, np.uint8)), offsets)
                raw = buf.tobytes()
            starts, ends, first, inverse = distinct_words(raw)
            distinct = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            if len(self.known) > WORDS_KEPT:  # words that come again move to the new generation
                self.before, self.known = self.known, {}
            self._learn([w for w in distinct if w not in self.known])
            ids = list(map(self.known.__getitem__, distinct))
            flat = np.frombuffer(b"".join(ids), np.uint16)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            begins = np.cumsum(sizes) - sizes
            n = sizes[inverse]
            upto = np.append(0, np.cumsum(n))
            tokens = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - begins[inverse], n)]
            cuts = upto[np.searchsorted(starts, offsets)]
            out += [tokens[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str) -> WordEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def sequence_schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes one shard; ids arrive document by document and are held for one batch at most."""

    def __init__(self, folder: str, name: str, length: int) -> None:
        self.filesystem, path = fs.FileSystem.from_uri(folder)
        self.filesystem.create_dir(path, recursive=True)
        self.path, self.length, self.held, self.size = f"{path}/{name}", length, [], 0
        self.sink = self.filesystem.open_output_stream(f"{self.path}.arrow")
        self.writer = pa.ipc.new_file(self.sink, sequence_schema(length))
        self.places: list[tuple[int | None, int, int]] = []
        self.total = 0
        self.docs_sink = self.filesystem.open_output_stream(f"{self.path}.docs.arrow")
        self.docs = pa.ipc.new_file(self.docs_sink, pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.places.append((doc, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.length * ROWS:
            self._flush(False)
        if len(self.places) >= 10_000:
            self._flush_places()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint16)
        block = self.length * ROWS
        stop = len(flat) if last else len(flat) // block * block
        for lo in range(0, stop, block):
            ids = flat[lo : min(lo + block, stop)]
            pad = -len(ids) % self.length
            mask = np.ones(len(ids) + pad, bool)
            mask[len(ids) :] = False
            ids = np.append(ids, np.zeros(pad, np.uint16)).astype(np.uint16)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.writer.write_batch(pa.record_batch(columns, schema=sequence_schema(self.length)))
        self.held, self.size = [flat[stop:]], len(flat) - stop

    def _flush_places(self) -> None:
        if self.places:
            self.docs.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.places, strict=True)], ["id", "start", "n"]))
        self.places = []

    def close(self) -> None:
        self._flush(True)
        self._flush_places()
        for x in (self.writer, self.sink, self.docs, self.docs_sink):
            x.close()


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; (shard, name, total, first) of each: shards in stream order have ascending ``shard``.

    ``first`` is the stream position of the shard's first id. A task that is run again writes files of
    another name; only the files of the attempt that counts are listed.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, writer, name = encoder(tokenizer_file), None, uuid.uuid4().hex
        end = np.uint16(end_id)
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            ids, texts, lo = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= TEXT_SPAN):
                    size += len(texts[hi] or "")
                    hi += 1
                for doc, found in zip(ids[lo:hi], own.encode(texts[lo:hi]), strict=True):
                    writer = writer or ShardWriter(folder, name, length)
                    writer.add(doc, np.append(found, end))
                lo = hi
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([writer.total])], ["shard", "name", "total"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # rows that share an id are split and ordered by a hash of the text
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    shards = stored(rows.select("id", "text").mapInArrow(tidy(work), "shard long, name string, total long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("first", F.coalesce(F.sum("total").over(before), F.lit(0)))


class Sequences:
    """Random access to the sequences of one shard through a memory map (a local or mounted file): nothing is copied or decoded."""

    def __init__(self, file: str) -> None:
        self.reader = pa.ipc.open_file(pa.memory_map(file))
        last = self.reader.num_record_batches - 1
        self.count = 0 if last < 0 else last * ROWS + self.reader.get_batch(last).num_rows

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence k: a view of the mapped file, and an Arrow slice of the mapped bits."""
        if not 0 <= k < self.count:
            raise IndexError(k)
        batch, row = self.reader.get_batch(k // ROWS), k % ROWS
        ids, mask = (batch.column(c).slice(row, 1).flatten() for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask


def read_documents(shards: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files of ``shards``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                filesystem, path = fs.FileSystem.from_uri(folder)
                with filesystem.open_input_file(f"{path}/{name}.arrow") as source, filesystem.open_input_file(f"{path}/{name}.docs.arrow") as docs_source:
                    reader, docs = pa.ipc.open_file(source), pa.ipc.open_file(docs_source)
                    at, held, base = -1, np.zeros(0, np.uint16), 0
                    for k in range(docs.num_record_batches):
                        places = docs.get_batch(k)
                        sums = []
                        for start, n in zip(places.column("start").to_pylist(), places.column("n").to_pylist(), strict=True):
                            crc = 0
                            while n:
                                if start >= base + len(held):  # documents follow each other, so do batches
                                    base += len(held)
                                    at += 1
                                    columns = reader.get_batch(at)
                                    mask = columns.column("mask").flatten().to_numpy(zero_copy_only=False)
                                    held = columns.column("ids").flatten().to_numpy()[: int(mask.sum())]
                                part = held[start - base : start - base + n]
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                                start, n = start + len(part), n - len(part)
                            sums.append(crc)
                        starts = pa.array(places.column("start").to_numpy() + first)
                        yield pa.record_batch([places.column("id"), starts, places.column("n"), pa.array(sums, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    one_each = shards.select("name", "first").repartition(max(1, shards.count()))
    return one_each.mapInArrow(work, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to token files and read them back: (id, start, n_tokens, ids_crc32) per row.

    Each document's ids end with ``end_id``; null and empty texts have only that one. Null ids come
    first; rows that share an id follow each other in the order of a hash of their text. Other columns
    are ignored; an empty table writes no file and gives an empty result.
    """
    folder = scratch(docs.sparkSession, "token-files")
    return read_documents(write_shards(docs, tokenizer_file, end_id, folder, length, id_col, text_col), folder, id_col)
