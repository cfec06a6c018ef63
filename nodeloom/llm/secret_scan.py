"""Secret scan: rules found through a trigram inverted index.

For each rule's regex a Boolean query of trigrams is derived that every match implies (over text
with A-Z lower-cased). The documents of a batch are indexed by the trigrams that the queries name;
the postings are intersected and united as the query says, and the regex runs on the documents that
remain. A rule whose regex has no mandatory trigram scans all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    flags: int = re.ASCII


#: The base rules, in their order, then the added ones. Fixed values.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]{20,}", 0, 0, re.ASCII | re.IGNORECASE),
)

#: A query: True (no trigram is mandatory), or a set of alternatives, each a set of trigrams that must all occur.
Query = bool | frozenset[frozenset[bytes]]
#: Most literal strings followed side by side, and most alternatives of a query, before a part counts as unknown.
MOST_STRINGS, MOST_ALTERNATIVES = 64, 256
#: Text bytes indexed at once.
SPAN = 1 << 22


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= MOST_ALTERNATIVES else min(a, b, key=len)


def _either(a: Query, b: Query) -> Query:
    return True if a is True or b is True or len(a | b) > MOST_ALTERNATIVES else a | b


def _grams(strings: set[str]) -> Query:
    """What one of the strings implies: all of its trigrams."""
    out = frozenset(frozenset(s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)) for s in strings)
    return True if frozenset() in out else out


def _members(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL and value < 128:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] < 128:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _strings(node: tuple) -> set[str] | None:
    """All lower-cased strings that a node can match, if they are few; None if not known."""
    op, value = node
    if op is sre.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is sre.IN:
        return _members(value)
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        out: set[str] = set()
        for way in value[1]:
            found = _sequence(way)
            if found is None:
                return None
            out |= found
        return out if len(out) <= MOST_STRINGS else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 2:
        one = _sequence(value[2])
        if one is None:
            return None
        out, row = ({""} if value[0] == 0 else set()), {""}
        for k in range(1, value[1] + 1):
            row = {a + b for a in row for b in one}
            if k >= value[0]:
                out |= row
        return out if len(out) <= MOST_STRINGS else None
    return {""} if op is sre.AT else None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _query(nodes) -> Query:
    """The query of a row of nodes: that of each run of known strings, and of each part that has its own."""
    out: Query = True
    run = {""}
    for node in nodes:
        found = _strings(node)
        if found is not None and len(run) * len(found) <= MOST_STRINGS:
            run = {a + b for a in run for b in found}
            continue
        out, run = _both(out, _grams(run)), {""}
        if found is not None:
            run = found
            continue
        op, value = node
        if op is sre.SUBPATTERN:
            out = _both(out, _query(value[3]))
        elif op is sre.BRANCH:
            ways = [_query(way) for way in value[1]]
            part = ways[0]
            for way in ways[1:]:
                part = _either(part, way)
            out = _both(out, part)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            out = _both(out, _query(value[2]))
    return _both(out, _grams(run))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The trigrams (lower-cased) that any text with a match of ``pattern`` holds."""
    return _query(sre_parse.parse(pattern, flags))


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Scanner:
    """The rules, their queries and the table that numbers the trigrams they name."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(rule, re.compile(rule.pattern, rule.flags), trigram_query(rule.pattern, rule.flags)) for rule in rules]
        named = sorted({g for _, _, q in self.rules if q is not True for way in q for g in way})
        self.number = {g: i for i, g in enumerate(named)}
        self.codes = np.array([int.from_bytes(g, "big") for g in named], np.int64)

    def postings(self, raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        """Per named trigram the sorted documents that hold it."""
        buf = _lower(np.frombuffer(raw, np.uint8)).astype(np.int32)
        code = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
        table = np.zeros(1 << 24, np.uint16 if len(self.codes) < 1 << 16 else np.int32)
        table[self.codes] = np.arange(1, len(self.codes) + 1)
        at = np.flatnonzero(table[code])
        which, doc = table[code[at]].astype(np.int64) - 1, np.searchsorted(offsets, at, "right") - 1
        pairs = np.unique(which * (len(offsets) + 1) + doc)
        cut = np.searchsorted(pairs, np.arange(len(self.codes) + 1) * (len(offsets) + 1))
        return [pairs[cut[i] : cut[i + 1]] - i * (len(offsets) + 1) for i in range(len(self.codes))]

    def candidates(self, query: Query, postings: list[np.ndarray], docs: int) -> np.ndarray:
        if query is True:
            return np.arange(docs)
        out = np.zeros(0, np.int64)
        for way in query:
            lists = sorted((postings[self.number[g]] for g in way), key=len)
            found = lists[0]
            for other in lists[1:]:
                found = np.intersect1d(found, other, assume_unique=True)
            out = np.union1d(out, found)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, rule number, end) in code points."""
        data = [t.encode() for t in texts]
        raw = b"\n".join(data) + b"\n\n\n"
        offsets = np.zeros(len(data), np.int64)
        offsets[1:] = np.cumsum([len(d) + 1 for d in data])[:-1]
        postings = self.postings(raw, offsets)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            docs = runs_of(raw, offsets, rule.least) if rule.pattern == HEX_RUN else self.candidates(query, postings, len(texts))
            for i in docs.tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


HEX_RUN = r"[0-9a-f]+"
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def runs_of(raw: bytes, offsets: np.ndarray, least: int) -> np.ndarray:
    """A full scan: the documents with a run of at least ``least`` hex digits."""
    gaps = np.flatnonzero(~_HEX[np.frombuffer(raw, np.uint8)])
    starts = np.append(-1, gaps[:-1])
    hits = starts[gaps - starts - 1 >= least] + 1
    return np.unique(np.searchsorted(offsets, hits, "right") - 1)


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) for every row: found lists the spans (kind, start, end) in code points, end exclusive.

    Spans are ordered by start, then by the order of the rules. Null and empty texts have none. Null
    and repeated ids are kept row by row, other columns are ignored, an empty table stays empty.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in batches:
            texts, lo = [t or "" for t in batch.column(1).to_pylist()], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SPAN):
                    size += len(texts[hi])
                    hi += 1
                found = [[(rules[k].kind, start, end) for start, k, end in row] for row in own.scan(texts[lo:hi])]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in row] for row in found], pa.list_(kind))], ["id", "found"])
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, found array<struct<kind: string, start: long, end: long>>").withColumnRenamed("id", id_col)


def secret_digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as one string."""
    name = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = [rule.kind for rule in base]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    own = F.filter("found", lambda s: s["kind"].isin(kinds))
    rest = [c for c in found.columns if c != "found"]
    return found.select(*rest, *counts, F.sha2(name(own), 256).alias("base_sha256"), name(F.col("found")).alias("spans"))
