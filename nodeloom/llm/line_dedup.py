"""Line dedup: an exact set-similarity join of lines, and documents without the later matches.

The tokens of a line are its five-word shingles (fewer words: the whole sequence). Lines are ordered
by (document id, line number). A line goes if an earlier line reaches Jaccard num/den with it,
whether or not that earlier line stays.

Equal token sets are one class, told by a 128-bit digest: all but its first line go at once. The first
lines are joined: tokens ordered by rarity (a sketch over all lines), prefix filter, length filter,
positional filter, then the true intersection:

* a star round pairs each line with the first line of each of its posting lists, which settles large groups of
  near copies with one pair per posting;
* what is left of a list of at most ``SHORT`` lines becomes pairs; they must share as many prefix tokens as
  their sizes ask for;
* the open lines of a longer list meet all its lines block by block in a task that holds one block and returns
  the lines that have an earlier match, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import BROADCAST_ROWS, Scratch, bitmap_of, bits_for, free_name, in_bitmap, may_be_among, once, tidy
from nodeloom.llm.wordhash import mix, scan_blocks, spans

#: Counters of the frequency sketch (fixed size) and most bits of a bitmap: what travels with tasks is bounded.
BINS_LOG2, MOST_BITS = 18, 26
#: Bits of a bitmap for each value in it: where few of all lines are wanted, most of what a fuller one lets through is not.
SPARE = 128
#: Parts in which tasks send their counters to be added up.
PARTS = 64
NULL_ID = -(1 << 63)
#: What the tasks of the sketch tell of their rows with words: smallest and largest id, largest line number.
EDGES = ("low", "high", "most")
#: Bits of a token that tell repeated ones, ranges of them (as a power of two), and tokens that a task packs at once.
LOW_BITS, RANGES_LOG2, PACKED = 31, 10, 1 << 22
#: Spreads the lines of a document over the bitmap of wanted lines.
STEP = 40503
#: Text bytes counted at once: what is made of them stays in a core's cache.
PIECE = 1 << 17
#: Longest posting list whose pairs become rows; open lines that a task holds; lines that it reads against them.
SHORT, BLOCK, READ = 32, 512, 8192
#: A line: its document's id, a hash of the text where ids may repeat (else 0), and its number.
X = "struct<id: long, h: long, line: int>"


class Naming:
    """How rows name a line: by a long that ends with ``bits`` bits of its number, or (None) by X. Both are in the order of the lines."""

    def __init__(self, bits: int | None) -> None:
        self.bits, self.type = bits, X if bits is None else "long"

    @classmethod
    def fitting(cls, low: int, high: int, most: int, repeated: bool) -> Naming:
        """A long if no id repeats and ids from low to high leave room for line numbers up to most."""
        bits = most.bit_length()
        return cls(None if repeated or bits > 31 or not -(1 << 63 - bits) <= low <= high < 1 << 63 - bits else bits)

    def name(self) -> Column:
        """Of the line of the columns id, h and line."""
        if self.bits is None:
            return F.struct("id", "h", "line")
        return F.shiftleft("id", self.bits).bitwiseOR(F.col("line").cast("long"))

    def parts(self, x: str = "x") -> tuple[Column, Column, Column]:
        """The document's id, the hash and the number of the line of this name."""
        if self.bits is None:
            return F.col(f"{x}.id"), F.col(f"{x}.h"), F.col(f"{x}.line")
        line = F.col(x).bitwiseAND(F.lit((1 << self.bits) - 1).cast("long")).cast("int")
        return F.shiftright(x, self.bits).alias("id"), F.lit(0).cast("long").alias("h"), line.alias("line")


def line_tokens(run: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, group) in order of occurrence, repeated ones too, and each group's (text, line): the lines with words."""
    raw = b"\n".join(run) + b"\n"
    hashes, starts = scan_blocks(raw.lower())
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    upto = np.append(0, np.searchsorted(starts, breaks))  # words in front of each line of all texts, numbered through
    counts = np.diff(upto)
    place = np.flatnonzero(counts)
    heads, counts = upto[place], counts[place]
    offsets = np.append(0, np.cumsum([len(x) + 1 for x in run])[:-1])
    firsts = np.searchsorted(breaks, offsets)
    text = np.searchsorted(firsts, place, "right") - 1
    line = place - firsts[text]
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashes) - width + 1)
    sums = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        sums[:n] += hashes[k : k + n] * factor[k]
    short = np.flatnonzero(counts < width)  # their whole sequence, and its length, is the token
    sums[heads[short]] = counts[short].astype(np.uint64)
    for k in range(width - 1):
        own = short[counts[short] > k]
        sums[heads[own]] += hashes[heads[own] + k] * factor[k]
    many = np.maximum(counts - width + 1, 1)
    at = np.arange(many.sum()) + np.repeat(heads - (np.cumsum(many) - many), many)
    return mix(sums[at]), np.repeat(np.arange(len(heads)), many), text, line


def _bin(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BINS_LOG2)).astype(np.int64)


def distinct_tokens(tokens: np.ndarray, group: np.ndarray, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (token, group) pairs by group, rank of the token's bin and token."""
    own = np.zeros(len(tokens), np.int64) if ranks is None else ranks[_bin(tokens)].astype(np.int64)
    spare = 62 - BINS_LOG2 - int(group.max(initial=0)).bit_length()
    order = None
    if spare > 16:  # one sort of whole numbers: group, rank, and the bits of the token behind its bin that fit
        key = (group << (BINS_LOG2 + spare)) | (own << spare) | ((tokens << np.uint64(BINS_LOG2)) >> np.uint64(64 - spare)).astype(np.int64)
        order = np.argsort(key)
        key = key[order]
        if ((key[1:] == key[:-1]) & (tokens[order][1:] != tokens[order][:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((tokens, own, group))
    tokens, group = tokens[order], group[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (group[1:] != group[:-1])
    return tokens[new], group[new]


def _sketch(docs: DataFrame, width: int, repeated: bool) -> tuple[np.ndarray, Naming]:
    """The place of each bin of tokens in the order of their counts over all lines, and the lines' naming."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, held, size = np.zeros(1 << BINS_LOG2, np.int64), [], 0
        low, high, most = (1 << 63) - 1, NULL_ID, 0
        for batch in batches:
            ids = batch.column(1).to_numpy()
            low, high = int(ids.min(initial=low)), int(ids.max(initial=high))
            for _, run in spans(batch.column(0).cast(pa.binary()).to_pylist(), PIECE):
                most = max(most, *(text.count(b"\n") for text in run))
                held.append(_bin(line_tokens(run, width)[0]))
                size += len(held[-1])
                if size > len(bins):
                    bins += np.bincount(np.concatenate(held), minlength=len(bins))
                    held, size = [], 0
        for rest in held:
            np.add.at(bins, rest, 1)
        if bins.any():
            edges = [pa.array([v] * PARTS, pa.int64()) for v in (low, high, most)]
            yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([part.tobytes() for part in np.split(bins, PARTS)], pa.binary()), *edges], ["part", "bins", *EDGES])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        edges: dict[int, list[int]] = {}
        for batch in batches:
            for part, bins, *own in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(c).to_pylist() for c in EDGES), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(bins.as_buffer(), np.int64)
                edges[part] = [f(v) for f, v in zip((min, max, max), zip(edges.get(part, own), own, strict=True), strict=True)]
        columns = [pa.array([edges[part][k] for part in sums], pa.int64()) for k in range(len(EDGES))]
        yield pa.record_batch([pa.array(sums, pa.int32()), pa.array([part.tobytes() for part in sums.values()], pa.binary()), *columns], ["part", "bins", *EDGES])

    kind = ", ".join(["part int", "bins binary", *(f"{c} long" for c in EDGES)])
    rows = docs.select("text", "id").mapInArrow(tidy(count), kind).repartition("part").mapInArrow(tidy(add), kind).toArrow()
    bins = np.zeros(1 << BINS_LOG2, np.int64)
    for part, counts in zip(rows.column("part").to_pylist(), rows.column("bins").to_pylist(), strict=True):
        np.split(bins, PARTS)[part][:] = np.frombuffer(counts, np.int64)
    ranks = np.empty(len(bins), np.int32)
    ranks[np.argsort(bins, kind="stable")] = np.arange(len(bins), dtype=np.int32)
    low, high, most = (rows.column(c).to_pylist() for c in EDGES)
    return ranks, Naming.fitting(min(low, default=0), max(high, default=0), max(most, default=0), repeated)


def line_table(docs: DataFrame, ranks: np.ndarray, naming: Naming, width: int, num: int, den: int) -> DataFrame:
    """(x, d1, d2, n, prefix) of every line of docs(id, h, text) that has words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, more = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            for first, run in spans(batch.column("text").cast(pa.binary()).to_pylist()):
                tokens, owner, text, line = line_tokens(run, width)
                if not len(tokens):
                    continue
                tokens, owner = distinct_tokens(tokens, owner, ranks)
                heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                n = np.diff(np.append(heads, len(tokens)))
                d1, d2 = np.add.reduceat(mix(tokens), heads), np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), heads)
                length = n + (-num * n // den) + 1  # n - ceil(num * n / den) + 1
                kept = np.arange(len(tokens)) - heads[owner] < length[owner]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(tokens[kept].view(np.int64)))
                columns = [ids[first + text], more[first + text], line.astype(np.int32), d1.view(np.int64), d2.view(np.int64), n.astype(np.int32)]
                yield pa.record_batch([*map(pa.array, columns), lists], ["id", "h", "line", "d1", "d2", "n", "prefix"])

    rows = docs.select("id", "h", "text").mapInArrow(tidy(build), "id long, h long, line int, d1 long, d2 long, n int, prefix array<long>")
    return rows.select(naming.name().alias("x"), "d1", "d2", "n", "prefix")


def _low_bits(again: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of repeated low bits and the mask of a place in it."""
    bits = bits_for(again.count(), MOST_BITS, SPARE)
    mask = (1 << bits) - 1
    return np.frombuffer(bitmap_of(again, F.col("low").bitwiseAND(F.lit(mask)).cast("long"), bits), np.uint8), mask


def _copies(lines: DataFrame, tables: Scratch) -> DataFrame:
    """(x) of the lines whose token set an earlier line has. Only lines whose digest may be repeated are grouped and joined."""
    found, mask = _low_bits(tables.store(repeated_tokens(lines.select(F.array("d1").alias("tokens"))), "repeated-digests"))
    rows = lines.select("x", "d1", "d2").where(in_bitmap(found.tobytes(), F.col("d1").bitwiseAND(F.lit(mask))))
    rows = tables.store(rows, "members")
    firsts = rows.groupBy("d1", "d2").agg(F.min("x").alias("first"), F.count("*").alias("c")).where("c > 1").select("d1", "d2", "first")
    return rows.join(firsts, ["d1", "d2"]).where("x <> first").select("x")


def _once(rows: DataFrame, repeated: bool) -> DataFrame:
    """One row per line x: only rows that are equal in id and text have the same lines."""
    return rows.dropDuplicates(["x"]) if repeated else rows


def repeated_tokens(lists: DataFrame) -> DataFrame:
    """(low): the low LOW_BITS bits of the tokens, one list a row, that occur more than once; a value that two tokens share only costs rows.

    Tasks send their tokens packed, by range of these bits. The task of a range marks what it has seen once and what again in two
    arrays whose size does not depend on the number of tokens.
    """
    width = LOW_BITS - RANGES_LOG2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange((1 << RANGES_LOG2) + 1, dtype=np.int64) << width

        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            low = np.sort(np.concatenate(held))
            cuts = np.searchsorted(low, edges)
            rows = np.flatnonzero(np.diff(cuts))
            data = low.astype("<i4")
            return pa.record_batch([pa.array(rows.astype(np.int32)), pa.array([data[cuts[r] : cuts[r + 1]].tobytes() for r in rows.tolist()], pa.binary())], ["range", "tokens"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False) & ((1 << LOW_BITS) - 1))
            size += len(held[-1])
            if size > PACKED:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(1 << width, bool), np.zeros(1 << width, bool)

        def found() -> Iterator[pa.RecordBatch]:
            low = (np.flatnonzero(twice) + (now << width)).astype(np.int32)
            for lo in range(0, len(low), 1 << 16):
                yield pa.record_batch([pa.array(low[lo : lo + (1 << 16)])], ["low"])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    if now is not None:
                        yield from found()
                    now = part
                    once[:], twice[:] = False, False
                values = np.frombuffer(data.as_buffer(), "<i4") - (part << width)  # sorted
                first = np.ones(len(values), bool)
                first[1:] = values[1:] != values[:-1]
                twice[values[~first]] = True
                values = values[first]
                twice[values[once[values]]] = True
                once[values] = True
        if now is not None:
            yield from found()

    rows = lists.mapInArrow(tidy(deal), "range int, tokens binary")
    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(tidy(again), "low int")


def _postings(lines: DataFrame, copies: DataFrame, tables: Scratch, naming: Naming, repeated: bool) -> DataFrame:
    """(tok, x, n, pos, c, y, m, q): the lines of each posting list of c > 1 first lines of classes; y is its first line."""
    found, mask = _low_bits(tables.store(repeated_tokens(lines.select("prefix")), "repeated-tokens"))
    bits = bits_for(copies.count(), MOST_BITS, SPARE)
    place = F.pmod(F.xxhash64("x"), F.lit(1 << bits))
    among = np.frombuffer(bitmap_of(copies, place, bits), np.uint8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            at = flat & mask
            hit = (found[at >> 3] >> (at & 7)) & 1 == 1
            upto = np.append(0, np.cumsum(hit))[ends]
            rows = np.flatnonzero(np.diff(upto))
            pos = (np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends))).astype(np.int32)[hit]
            cuts = pa.array(np.append(0, upto[1:][rows]).astype(np.int32))
            taken = [batch.column(c).take(pa.array(rows)) for c in ("x", "n")]
            at = batch.column("place").to_numpy()[rows]
            maybe = pa.array((among[at >> 3] >> (at & 7)) & 1 == 1)
            yield pa.record_batch([*taken, pa.ListArray.from_arrays(cuts, pa.array(flat[hit])), pa.ListArray.from_arrays(cuts, pa.array(pos)), maybe], ["x", "n", "tok", "pos", "maybe"])

    rows = lines.select("x", "n", "prefix", place.alias("place")).mapInArrow(tidy(keep), f"x {naming.type}, n int, tok array<long>, pos array<int>, maybe boolean")
    rows = tables.store(rows, "postings")
    tables.drop("lines", "repeated-tokens")
    # only lines that may be copies move to be told from them
    rows = rows.where("not maybe").drop("maybe").union(rows.where("maybe").drop("maybe").join(copies, "x", "left_anti"))
    if repeated:
        rows = tables.store(_once(rows, repeated), "once")
        tables.drop("postings")
    rows = rows.select("x", "n", F.explode(F.arrays_zip("tok", "pos")).alias("p")).select("p.tok", "x", "n", "p.pos")
    heads = rows.groupBy("tok").agg(F.count("*").alias("c"), F.min("x").alias("y"), F.min_by("n", "x").alias("m"), F.min_by("pos", "x").alias("q")).where("c > 1")
    lists = tables.store(rows.join(heads, "tok"), "lists")
    tables.drop("once" if repeated else "postings")
    return lists


def _wanted(own: Column, h: Column, bits: int) -> Column:
    """The bit of a line in the bitmap of wanted lines, less what its line number adds."""
    return F.pmod(F.xxhash64(own, h), F.lit(1 << bits))


def _line_sets(docs: DataFrame, nodes: DataFrame, width: int, naming: Naming, repeated: bool) -> DataFrame:
    """(x, tokens) of the wanted lines (x), and a few others: only these lines of a text are cut into tokens."""
    bits = bits_for(nodes.count(), MOST_BITS, SPARE)
    own, h, line = naming.parts()
    place = F.pmod(_wanted(own, h, bits) + line.cast("long") * F.lit(STEP), F.lit(1 << bits))
    wanted = np.frombuffer(bitmap_of(nodes, place, bits), np.uint8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, more, place = (batch.column(c).to_numpy() for c in ("id", "h", "place"))
            for first, run in spans(batch.column("text").cast(pa.binary()).to_pylist()):
                raw = b"\n".join(run) + b"\n"
                ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
                starts = np.append(0, ends[:-1] + 1)
                offsets = np.append(0, np.cumsum([len(t) + 1 for t in run])[:-1])
                text = np.searchsorted(offsets, starts, "right") - 1
                line = np.arange(len(starts)) - np.searchsorted(starts, offsets)[text]
                at = (place[first + text] + line * STEP) & ((1 << bits) - 1)
                hit = np.flatnonzero((wanted[at >> 3] >> (at & 7)) & 1)
                tokens, owner, which, _ = line_tokens([raw[a:b] for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)], width)
                if len(tokens):
                    tokens, owner = distinct_tokens(tokens, owner)
                    cuts = np.append(0, np.cumsum(np.bincount(owner))).astype(np.int32)
                    row = hit[which]
                    columns = [ids[first + text[row]], more[first + text[row]], line[row].astype(np.int32)]
                    yield pa.record_batch([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens.view(np.int64)))], ["id", "h", "line", "tokens"])

    rows = docs.select("id", "h", "text", _wanted(F.col("id"), F.col("h"), bits).alias("place")).mapInArrow(tidy(keep), "id long, h long, line int, tokens array<long>")
    return _once(rows.select(naming.name().alias("x"), "tokens"), repeated)


def _near(num: int, den: int) -> Column:
    """Length filter of sizes n and m."""
    return F.expr(f"{den} * least(n, m) >= {num} * greatest(n, m)")


def _needed(num: int, den: int) -> Column:
    """How many tokens the prefixes of lines of sizes n and m at the threshold share.

    They share o tokens at least; the j-th of them is among the first j + n - o of the one and the first j + m - o of the other.
    """
    o = F.ceil(num * (F.col("n") + F.col("m")) / F.lit(num + den))
    return o + 1 - F.greatest(*(F.ceil(num * F.col(size) / F.lit(den)) for size in ("n", "m")))


def _matched(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The later lines x of the pairs whose sets reach the threshold."""
    # both joins ask for the sets by the same columns, so these move once
    both = pairs.select(F.col("x").alias("later"), F.col("y").alias("earlier"))
    both = both.join(sets.alias("a"), F.col("later") == F.col("a.x")).join(sets.alias("b"), F.col("earlier") == F.col("b.x"))
    both = both.select(F.col("later").alias("x"), F.col("a.tokens").alias("tokens"), F.col("b.tokens").alias("others"))
    both = both.withColumn("shared", F.size(F.array_intersect("tokens", "others")))
    return both.where(f"{den} * shared >= {num} * (size(tokens) + size(others) - shared)").select("x")


def _short_pairs(lists: DataFrame, open_lines: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) of open lines x and earlier lines y of the lists of 3 to SHORT lines.

    A pair that shares a longer list is compared there, one that shares a list of two was a pair of the star, so for any other
    pair the tokens counted here are all that the prefixes share.
    """
    between = F.col("c").between(3, SHORT)
    other = lists.where(between).select("tok", F.col("x").alias("y"), F.col("n").alias("m"))
    pairs = open_lines.where(between).select("tok", "x", "n").join(other, "tok").where("y < x").where(_near(num, den))
    return pairs.groupBy("x", "y").agg(F.count("*").alias("shared"), F.first(_needed(num, den)).alias("least")).where("shared >= least").select("x", "y")


def has_earlier_match(held: list[tuple], index: tuple, line: tuple, tokens: np.ndarray, done: np.ndarray, num: int, den: int) -> None:
    """Mark in ``done`` the held lines that are later than the given one and match it."""
    flat, owner, sizes = index
    lo, hi = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
    counts = hi - lo
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    both = np.bincount(owner[at], minlength=len(sizes))
    for i in np.flatnonzero((den * both >= num * (sizes + len(tokens) - both)) & (both > 0) & ~done):
        done[i] = line < held[i][0]


def _long_matches(lists: DataFrame, gone: DataFrame, sets: DataFrame, naming: Naming, num: int, den: int) -> DataFrame:
    """(x) of the open lines of long lists that have an earlier match there.

    A list's open lines are dealt to blocks of about BLOCK, all its lines to blocks of about READ; each pair
    of blocks is a group of rows, its open lines first.
    """
    rows = lists.select("tok", "x", "c").join(gone.withColumn("settled", F.lit(1)), "x", "left")
    sizes = rows.groupBy("tok").agg(F.sum(F.when(F.col("settled").isNull(), 1).otherwise(0)).alias("u"), F.first("c").alias("c")).where("u > 0")
    sizes = sizes.select("tok", F.ceil(F.col("u") / BLOCK).alias("i"), F.ceil(F.col("c") / READ).alias("j"))
    rows = rows.join(sizes, "tok").withColumn("deal", F.xxhash64("x"))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.where("settled is null").select("tok", F.pmod("deal", "i").alias("i"), to("j").alias("j"), F.lit(0).alias("side"), "x")
    read = rows.select("tok", to("i").alias("i"), F.pmod("deal", "j").alias("j"), F.lit(1).alias("side"), "x")
    both = held.union(read).join(sets, "x").repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index, done = None, [], None, np.zeros(0, bool)

        def found() -> pa.RecordBatch:
            x = [held[i][0] for i in np.flatnonzero(done)]
            return pa.record_batch([pa.array([v[k] for v in x], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["id", "h", "line"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("tok", "i", "j")), strict=True)
            lists = batch.column("tokens")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            lines = zip(*(batch.column(c).to_pylist() for c in ("id", "h", "line")), strict=True)
            for k, (key, side, line) in enumerate(zip(keys, batch.column("side").to_pylist(), lines, strict=True)):
                if key != now:
                    if done.any():
                        yield found()
                    now, held, index, done = key, [], None, np.zeros(0, bool)
                tokens = flat[ends[k] : ends[k + 1]]
                if side == 0:
                    held.append((line, tokens.copy()))
                    continue
                if index is None and held:
                    every = np.concatenate([t for _, t in held])
                    sizes = np.array([len(t) for _, t in held])
                    order = np.argsort(every)
                    index, done = (every[order], np.repeat(np.arange(len(held)), sizes)[order], sizes), np.zeros(len(held), bool)
                if held:
                    has_earlier_match(held, index, line, tokens, done, num, den)
        if done.any():
            yield found()

    rows = both.select("tok", "i", "j", "side", *naming.parts(), "tokens").mapInArrow(tidy(compare), "id long, h long, line int")
    return rows.select(naming.name().alias("x"))


def removed_lines(docs: DataFrame, tables: Scratch, repeated: bool, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, h, removed): per document of docs(id, h, text) that loses lines, their sorted numbers from 0.

    ``repeated`` says whether several rows may have the same id and h. A table goes as soon as no later step reads it.
    """
    ranks, naming = _sketch(docs, width, repeated)
    lines = tables.store(line_table(docs, ranks, naming, width, num, den), "lines")
    copies = tables.store(_copies(lines, tables), "copies")
    tables.drop("repeated-digests", "members")
    lists = _postings(lines, copies, tables, naming, repeated)
    positional = f"{num + den} * (least(pos, q) + least(n - pos, m - q)) >= {num} * (n + m)"
    star = tables.store(lists.where("x <> y").where(_near(num, den)).where(positional).select("x", "y").distinct(), "star")
    sets = tables.store(_line_sets(docs, star.select("x").union(star.select("y")), width, naming, repeated), "line-sets")
    gone = tables.store(_matched(star, sets, num, den).distinct(), "gone")
    tables.drop("line-sets")
    open_lines = lists.where("c > 2").join(gone, "x", "left_anti")
    pairs = tables.store(_short_pairs(lists, open_lines, num, den).join(star, ["x", "y"], "left_anti"), "pairs")
    tables.drop("star")
    long = lists.where(F.col("c") > SHORT)
    sets = tables.store(_line_sets(docs, pairs.select("x").union(pairs.select("y")).union(long.select("x")), width, naming, repeated), "line-sets")
    more = _matched(pairs, sets, num, den).union(_long_matches(long, gone, sets, naming, num, den))
    every = copies.union(gone).union(more)
    return every.select(*naming.parts()).groupBy("id", "h").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _small(gone: DataFrame) -> bool:
    """Whether rows and removed lines are few enough to broadcast."""
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    return rows <= BROADCAST_ROWS // 10 and numbers <= BROADCAST_ROWS


def _without(text: Column, removed: Column) -> Column:
    """The text without the lines of the given numbers (null: as it is)."""

    def rest(t: str | None, gone: np.ndarray | None) -> str | None:
        if t is None or gone is None:
            return t
        less = set(gone.tolist())
        return "\n".join([part for k, part in enumerate(t.split("\n")) if k not in less])

    @F.pandas_udf("string")
    def without(text: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([rest(t, gone) for t, gone in zip(text, removed, strict=True)], dtype=object)

    return once(without)(text, removed)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with ``text_col`` rewritten without its removed lines, plus columns _lines and _removed (counts).

    Lines end at LF. Lines without words are never matched or removed. A null text stays null (no
    lines), an empty one empty. Rows that share an id (null is an id before all others) are documents of their own, in
    the order of a hash of their text; rows with equal id and text are one document: their first lines stay in each. An empty
    table stays empty. Other columns pass unchanged, whatever their names; if docs has a column ``_lines`` or
    ``_removed``, the count's name gets underscores behind it until it is free.
    """
    tables = Scratch(docs.sparkSession, "line-dedup", dictionary=False)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    again = tables.store(docs.groupBy(key.alias("id")).count().where("count > 1").select("id"), "repeated-ids")
    repeated = not again.isEmpty()
    h = F.lit(0).cast("long") if not repeated else F.when(may_be_among(again, F.col("id"), key, MOST_BITS), F.xxhash64(text_col)).otherwise(0)
    gone = removed_lines(docs.select(key.alias("id"), h.alias("h"), F.col(text_col).alias("text")), tables, repeated, width, num, den)
    gone = Scratch(docs.sparkSession, "removed-lines").store(gone, "removed")
    tables.drop()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("id"), h.alias("h"))
    text = F.col(f"row.`{text_col}`")
    lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    names = [free_name(docs, "_lines"), free_name(docs, "_removed")]

    def result(rows: DataFrame, own: Column, removed: Column) -> DataFrame:
        columns = [own.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
        return rows.select(*columns, lines.alias(names[0]), removed.alias(names[1]))

    def joined(rows: DataFrame, other: DataFrame) -> DataFrame:
        return result(rows.join(other, ["id", "h"], "left"), _without(text, F.col("removed")), F.coalesce(F.size("removed"), F.lit(0)))

    if _small(gone):
        return joined(packed, F.broadcast(gone))
    # only texts that may lose lines move; a shuffled join keeps the two Python functions in tasks of their own
    packed = packed.withColumn("hit", may_be_among(gone, F.col("id"), F.col("id"), MOST_BITS))
    return joined(packed.where("hit"), gone.hint("merge")).unionByName(result(packed.where("not hit"), text, F.lit(0)))
