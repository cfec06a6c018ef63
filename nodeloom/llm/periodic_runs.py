"""Periodic runs: stretches of words that repeat with a period, all of them, and texts with the repeats taken out.

A run of period q is a stretch of at least 2 * q words in which words q apart are identical, that no neighbour extends
and no smaller period fits. It holds two neighbouring points of the grid 0, q, 2q, ..., so the pairs of neighbouring points of
all periods, n * ln(n) of them, meet every run. How far the words around a pair agree (LCE) is found by binary search on
prefix hashes for all pairs of many documents at once; one comparison of half the length that a run needs leaves few pairs for it.
Runs found from several pairs or multiples of their period are one by start and end. Every run is then
compared word by word; should a hash have deceived, the documents are searched again with exact names of blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import free_name, give_back, once
from nodeloom.llm.wordhash import mix

#: Fewest words of a run.
LEAST = 12
#: Text bytes searched together (a longer text alone); pairs of grid points in arrays at once.
SPAN, PAIRS = 1 << 18, 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Hashes:
    """Whether two stretches have equal prefix hashes: never false for equal ones."""

    def __init__(self, ids: np.ndarray) -> None:
        self.powers = np.full(len(ids) + 1, _BASE, np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64)) * self.powers[:-1], out=self.sums[1:])

    def same(self, i: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Compare ``size`` words from i on with those from i + q on."""
        s, j = self.sums, i + q
        return (s[i + size] - s[i]) * self.powers[q] == s[j + size] - s[j]


class Names:
    """The same, exactly: blocks of 2**k words have equal names if they are equal."""

    def __init__(self, ids: np.ndarray, longest: int) -> None:
        self.levels = [ids]
        while 2 << (len(self.levels) - 1) <= longest:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            both = last[:-step] * (int(last.max()) + 1) + last[step:]
            self.levels.append(np.unique(both, return_inverse=True)[1])

    def same(self, i: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = size == 0
        level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1  # floor of log2
        for k, names in enumerate(self.levels):
            own = np.flatnonzero((level == k) & (size > 0))
            if len(own):
                a, d, last = i[own], q[own], size[own] - (1 << k)
                out[own] = (names[a] == names[a + d]) & (names[a + last] == names[a + d + last])
        return out


def _extent(test: Hashes | Names, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i on (or in front of it) equal those q later, at most ``most``: all pairs search at once."""
    lo, hi = np.zeros(len(i), np.int64), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        equal = test.same(i - mid if back else i, q, mid)
        lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
    return lo


def _one_each(runs: np.ndarray) -> np.ndarray:
    """(start, stop, period) rows in order, one per start and stop: that of the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def _found(test: Hashes | Names, first: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """(start, stop, period) of the runs of the documents ids[first:last], as ``test`` sees them."""
    half = (last - first) // 2
    doc = np.repeat(np.arange(len(first)), half)
    period = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half) + 1
    points = (last[doc] - first[doc] - 1) // period
    upto = np.append(0, np.cumsum(points))
    parts, lo = [np.zeros((0, 3), np.int64)], 0
    while lo < len(period):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        n = points[lo:hi]
        q = np.repeat(period[lo:hi], n)
        at = (np.arange(len(q)) - np.repeat(upto[lo:hi] - upto[lo], n)) * q
        begin, stop = np.repeat(first[doc[lo:hi]], n), np.repeat(last[doc[lo:hi]], n)
        i = begin + at
        need = np.maximum(q, least - q)  # a run's words but for one period agree with those a period later
        part = (need + 1) >> 1  # half of them on one side of the pair at least
        room = i + q + part <= stop
        near = room & test.same(i, q, np.where(room, part, 0))
        rest = np.flatnonzero(~near & (at >= part))
        near[rest] = test.same(i[rest] - part[rest], q[rest], part[rest])
        i, q, begin, stop, need = (x[near] for x in (i, q, begin, stop, need))
        ahead, behind = _extent(test, i, q, stop - i - q, False), _extent(test, i, q, i - begin, True)
        taken = ahead + behind >= need
        parts.append(_one_each(np.stack([i - behind, i + q + ahead, q], 1)[taken]))
        lo = hi
    return _one_each(np.concatenate(parts))


def _proved(ids: np.ndarray, runs: np.ndarray) -> bool:
    """Whether the words of every run really repeat with its period."""
    size = runs[:, 1] - runs[:, 0] - runs[:, 2]
    upto, lo = np.append(0, np.cumsum(size)), 0
    while lo < len(runs):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        own = size[lo:hi]
        at = np.arange(own.sum()) + np.repeat(runs[lo:hi, 0] - (upto[lo:hi] - upto[lo]), own)
        if (ids[at] != ids[at + np.repeat(runs[lo:hi, 2], own)]).any():
            return False
        lo = hi
    return True


def runs_of(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, stop, period) of every run in the sequences ids[offsets[k]:offsets[k + 1]], by start and stop; none crosses sequences."""
    first, last = offsets[:-1], offsets[1:]
    runs = _found(Hashes(ids), first, last, least)
    if not _proved(ids, runs):
        runs = _found(Names(ids, int((last - first).max())), first, last, least)
    return runs


def repeated_tail(n: int, g: int) -> np.ndarray:
    """The words that a text of n words has if its words from g % n on are a short stretch again and again."""
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % period
    return index


def searched(texts: list[bytes], tails: list[int | None], least: int) -> tuple[np.ndarray, np.ndarray, list[int], list[str]]:
    """(start, length, period) of the runs of all texts, where each text's runs begin, and the texts' numbers of words and rests without repeats."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    words, sizes, parts = [], [], []
    for text, g in zip(texts, tails, strict=True):
        own = text.split()  # bytes are split at 0x20 and 0x09-0x0D
        if g is not None and own:
            own = [own[k] for k in repeated_tail(len(own), g).tolist()]
        words.append(own)
        sizes.append(len(own))
        parts.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
    offsets = np.append(0, np.cumsum(sizes))
    runs = runs_of(np.concatenate(parts), offsets, least) if offsets[-1] else np.zeros((0, 3), np.int64)
    start, stop, period = runs.T
    change = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    kept = np.cumsum(change)[:-1] == 0
    cuts = np.searchsorted(start, offsets)
    lost = np.add.reduceat(np.append(~kept, False), offsets[:-1]) if len(texts) else []
    out = []
    for k, own in enumerate(words):
        left = compress(own, kept[offsets[k] : offsets[k + 1]].tolist()) if sizes[k] and lost[k] else own
        out.append(b" ".join(left).decode())
    base = np.repeat(offsets[:-1], np.diff(cuts))
    return np.stack([start - base, stop - start, period], 1), cuts, sizes, out


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, tail: Column | None = None) -> DataFrame:
    """docs plus n_words, ``runs`` (start, length and period of every run, by start and length) and ``collapsed``.

    Words are maximal runs of characters other than 0x20 and 0x09-0x0D, compared as they are, and numbered from 0.
    ``collapsed`` has the words that no run holds behind its first period, joined by one space. A null text counts as
    empty: no words, no runs, and an empty ``collapsed``. Rows stand alone, so repeated rows and ids give repeated results; an
    empty table gives an empty one. Other columns pass unchanged; where docs has a column of a result's name, the new one gets
    underscores behind its name until it is free. Where ``tail`` (a long) is not null, ``repeated_tail`` rewrites the
    words first: repeats planted for a test. No row moves to another task.
    """

    @F.arrow_udf(f"struct<n_words: long, runs: {_RUNS}, collapsed: string>")
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, seed in batches:
            texts, seeds = [(t or "").encode() for t in text.to_pylist()], seed.to_pylist()
            found, lo = [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SPAN):
                    size += len(texts[hi])
                    hi += 1
                runs, cuts, sizes, out = searched(texts[lo:hi], seeds[lo:hi], least)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], fields=list(_RUN))
                found.append(pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values), pa.array(out, pa.string())], ["n_words", "runs", "collapsed"]))
                lo = hi
            yield pa.concat_arrays(found)
        give_back()

    made, taken, names = free_name(docs, "_made"), docs, {}
    for c in ("n_words", "runs", "collapsed"):
        names[c] = free_name(taken, c)
        taken = taken.withColumn(names[c], F.lit(None))
    out = docs.withColumn(made, once(work)(F.col(text_col), (F.lit(None) if tail is None else tail).cast("long")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{made}.{c}").alias(name) for c, name in names.items()))


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of runs, the longest (ties: smallest start, then period; none: nulls), and SHA-256 of all runs and of ``collapsed``.

    Documents whose id has a CRC-32 that 10 divides have their tail repeated first; a null id has none.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    rows = with_runs(own, "text", tail=F.col("g")).select("doc_id", "runs", "collapsed")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
