"""SentencePiece encoding and decoding by suffix-array matching.

A BPE model never joins a letter with a space mark behind it, so a text is a row of independent
units: a run of space marks and the letters that follow. The units of a batch are laid end to end, each distinct one once, as
equal units have equal paths (those of the batches before are kept); a suffix array over that text is searched for every
piece of the vocabulary, which gives the range of its occurrences; the occurrences are edges, sorted by end position, and one pass
over them relaxes each position: an edge extends the path to its start if its piece may follow the
last piece there, that is, if merging the two pieces' characters gives these two pieces again.
Exactly one last piece is possible at each position, so the path equals the model's own merges. All units go this way:
runs of space marks and control characters too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import kept, tidy
from nodeloom.llm.wordhash import BLANK, distinct_words, mix, spans

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
ODD = re.compile(f"  |^ | $|{MARK}", re.ASCII)
#: Texts on which a model's own encoder must agree: no normalisation, its kind of merges, bytes for what is no piece.
PROBES = ("", "a b", "  two  blanks ", "ﬁ Å① ｗｉｄｅ é\u0301", "\0 \0\0x", "漢字 𝔘𝔘", "tab\tand\nlines\n\n", "▁ mark▁▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbb", " " * 40)
#: Characters indexed at once; bytes of text whose words are looked up at once; units and (as a power of two) verdicts kept between batches.
SPAN, RUN, UNITS_KEPT, VERDICTS_LOG2 = 150_000, 1 << 20, 100_000, 20
#: Characters compared at once, and the bits of each (a code point and one).
BLOCK, WIDE = 3, 21
#: Longest unit that is relaxed together with others, in characters.
SIDE_BY_SIDE = 64
#: Makes token numbers positive (a character that is no piece has a negative one); no piece yet.
OFFSET, NONE = 1 << 20 | 1 << 17, -(1 << 40)
#: Text characters encoded before a batch of rows is passed on.
TEXT_SPAN = 1_000_000


class Codec:
    """Encoder and decoder for one BPE model file with byte fallback and identity normalisation (any other file is an error)."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [model.id_to_piece(i).replace(MARK, " ").encode() for i in range(model.vocab_size())]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.text_of = {i: p for p, i in self.ids.items()}
        pieces = sorted(self.ids)
        self.piece_ids = np.array([self.ids[p] for p in pieces])
        self.lengths = np.array([len(p) for p in pieces])
        self.depth = int(self.lengths.max())
        codes = np.zeros((len(pieces), -(-self.depth // BLOCK), BLOCK), np.int64)
        for row, piece in enumerate(pieces):
            codes[row].flat[: len(piece)] = [ord(c) + 1 for c in piece]
        free = (1 << WIDE) - 1
        #: The smallest and the largest blocks that a text may have where a piece is.
        self.least, self.most = (sum(part[:, :, j] << WIDE * (BLOCK - 1 - j) for j in range(BLOCK)) for part in (codes, np.where(codes, codes, free)))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece of the model has a letter in front of a space mark: its texts are no row of units")
        self.forget()
        self.keys, self.verdicts = np.full(1 << VERDICTS_LOG2, -1, np.int64), np.zeros(1 << VERDICTS_LOG2, bool)
        if [ids.tolist() for ids in self.encode(list(PROBES))] != [model.encode(t) for t in PROBES]:
            raise ValueError("the model normalises texts or merges in another way")

    def forget(self) -> None:
        """Let go of the units met so far; they are most of what a codec holds."""
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text, one by one: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return self.text_of[token] if token >= 0 else chr(-token - 2)

    def may_follow(self, left: int, right: int) -> bool:
        a, b = self._text(left), self._text(right)
        return self.merged(a + b) == [a, b]

    def suffix_array(self, blocks: np.ndarray) -> np.ndarray:
        """Suffixes in order of their first ``depth`` characters, by prefix doubling from the blocks that start at each position."""
        key, width = blocks, BLOCK
        order = np.argsort(key)
        while width < self.depth:
            ordered = key[order]
            steps = np.ones(len(key), np.int64)
            steps[1:] = ordered[1:] != ordered[:-1]
            rank = np.empty_like(key)
            rank[order] = np.cumsum(steps)
            key = rank * (len(rank) + 2)
            key[:-width] += rank[width:]
            order = np.argsort(key)
            width *= 2
        return order

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every occurrence of every piece."""
        padded = np.append(codes, np.zeros(self.depth + BLOCK, np.int64))
        blocks = sum(padded[j : len(padded) - BLOCK + 1 + j] << WIDE * (BLOCK - 1 - j) for j in range(BLOCK))
        array = self.suffix_array(blocks[: len(codes)])
        heads = blocks[array]
        lo, hi = np.searchsorted(heads, self.least[:, 0], "left"), np.searchsorted(heads, self.most[:, 0], "right")
        for k in range(BLOCK, self.depth, BLOCK):
            live = np.flatnonzero((self.lengths > k) & (lo < hi))
            found = []
            for right, want in ((False, self.least), (True, self.most)):  # the first suffix whose next block is not below, or is above, the piece's
                want = want[live, k // BLOCK]
                a, b = lo[live], hi[live]
                while (a < b).any():
                    mid = (a + b) // 2
                    here = blocks[array[np.minimum(mid, len(array) - 1)] + k]
                    below = (a < b) & ((here <= want) if right else (here < want))
                    a, b = np.where(below, mid + 1, a), np.where((a < b) & ~below, mid, b)
                found.append(a)
            lo[live], hi[live] = found
        counts = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        start = array[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[which]]
        length, token = self.lengths[which], self.piece_ids[which]
        bare = np.ones(len(codes), bool)  # characters that are no piece of their own
        bare[start[length == 1]] = False
        bare &= codes > 0
        more = np.flatnonzero(bare)
        start, length = np.append(start, more), np.append(length, 1 + 0 * more)
        token = np.append(token, -codes[more] - 1)
        return start, start + length, token

    def judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` for many pairs; a table of fixed size keeps the last verdict of each of its places."""
        keys = ((left + OFFSET) << 21) | (right + OFFSET)
        at = (mix(keys.astype(np.uint64)) >> np.uint64(64 - VERDICTS_LOG2)).astype(np.int64)
        out = self.verdicts[at]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            new, inverse = np.unique(keys[miss], return_inverse=True)
            out[miss] = np.array([self.may_follow((k >> 21) - OFFSET, (k & ((1 << 21) - 1)) - OFFSET) for k in new.tolist()])[inverse]
            miss = miss[np.unique(at[miss], return_index=True)[1]]  # one pair a place
            self.keys[at[miss]], self.verdicts[at[miss]] = keys[miss], out[miss]
        return out

    def relax(self, starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last piece of the path to each position, and where that piece starts.

        Positions of many short units are relaxed side by side, those of a long unit one by one.
        """
        last, back = np.full(int(ends.max(initial=0)) + 2, NONE), np.zeros(int(ends.max(initial=0)) + 2, np.int64)
        last[first] = -1
        unit = np.repeat(np.arange(len(sizes)), sizes + 1)[starts]
        brief = sizes[unit] <= SIDE_BY_SIDE
        at = np.flatnonzero(brief)
        key = (((ends[at] - first[unit[at]]) << 8) | (255 - (ends[at] - starts[at]))).astype(np.uint16)
        order = np.argsort(key, kind="stable")  # numbers of 16 bits are sorted without comparing them
        key, order = key[order], at[order]
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = order[lo:hi]
            left = last[starts[e]]
            live = (left != NONE) & (last[ends[e]] == NONE)
            e, left = e[live], left[live]
            ok = left == -1
            inner = np.flatnonzero(~ok)
            if len(inner):
                ok[inner] = self.judge(left[inner], tokens[e[inner]])
            e = e[ok]
            last[ends[e]], back[ends[e]] = tokens[e], starts[e]
        at = np.flatnonzero(~brief)
        order = at[np.lexsort((starts[at], ends[at]))]
        kept: dict[tuple[int, int], bool] = {}
        for start, end, token in zip(starts[order].tolist(), ends[order].tolist(), tokens[order].tolist(), strict=True):
            left = last[start]
            if left != NONE and last[end] == NONE:
                pair = (int(left), token)
                if left != -1 and pair not in kept:
                    kept[pair] = self.may_follow(*pair)
                if left == -1 or kept[pair]:
                    last[end], back[end] = token, start
        return last, back

    def learn(self, units: list[str]) -> None:
        """Put the ids of the units (as 32-bit integers) into ``known``."""
        sizes = np.array([len(u) for u in units])
        first = np.append(0, np.cumsum(sizes + 1)[:-1])
        codes = np.zeros(int((sizes + 1).sum()), np.int64)  # a character's code point and one, 0 behind each unit
        letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(len(letters)) + np.repeat(np.arange(len(units)), sizes)] = letters.astype(np.int64) + 1
        last, back = self.relax(*self.edges(codes), first, sizes)
        at, owner = first + sizes, np.arange(len(units))
        paths, owners = [], []
        while len(owner):
            token = last[at]
            if (token == NONE).any():
                raise ValueError(f"no path through {units[owner[token == NONE][0]]!r}: the model's pieces are not closed under its merges")
            paths.append(token)
            owners.append(owner)
            at = back[at]
            going = at > first[owner]
            at, owner = at[going], owner[going]
        tokens, owners = np.concatenate(paths[::-1]), np.concatenate(owners[::-1])
        tokens = tokens[np.argsort(owners, kind="stable")]
        ends = np.cumsum(np.bincount(owners, minlength=len(units)))
        bare = set(np.sort(owners)[tokens < 0].tolist())
        data = tokens.astype(np.int32).tobytes()
        at = 0
        for i, (unit, end) in enumerate(zip(units, ends.tolist(), strict=True)):
            if i in bare:
                out: list[int] = []
                for token in tokens[at:end].tolist():
                    out += [token] if token >= 0 else [self.byte_ids[b] for b in chr(-token - 2).encode("utf-8", "surrogatepass")]
                self.known[unit] = np.array(out, np.int32).tobytes()
            else:
                self.known[unit] = data[4 * at : 4 * end]
            at = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        odd = [bool(t and ODD.search(t)) for t in texts]
        plain = [i for i, t in enumerate(texts) if t and not odd[i]]
        for first, run in spans([texts[i] for i in plain], RUN):
            for i, ids in zip(plain[first : first + len(run)], self._encode_plain(run), strict=True):
                out[i] = ids
        for i, text in enumerate(texts):
            if odd[i]:
                out[i] = self._encode_odd(text)
        return out

    def _ready(self, units: list[str]) -> None:
        """Make sure that ``known`` has the units; those that come again move to its new generation."""
        if len(self.known) > UNITS_KEPT:
            self.before, self.known = self.known, {}
        fresh, size = [], 0
        for unit in units:
            if unit not in self.known:
                if (ids := self.before.get(unit)) is not None:
                    self.known[unit] = ids
                else:
                    fresh.append(unit)
                    size += len(unit) + 1
                    if size > SPAN:
                        self.learn(fresh)
                        fresh, size = [], 0
        if fresh:
            self.learn(fresh)

    def _encode_plain(self, run: list[bytes]) -> list[np.ndarray]:
        """Texts whose words are parted by single spaces: each distinct word is looked up once."""
        raw = b" ".join(run) + b" "
        starts, ends, first, inverse = distinct_words(raw, BLANK)
        units = [MARK + raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self._ready(units)
        ids = [self.known[u] for u in units]
        flat = np.frombuffer(b"".join(ids), np.int32)
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        n = sizes[inverse]
        upto = np.append(0, np.cumsum(n))
        tokens = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - (np.cumsum(sizes) - sizes)[inverse], n)]
        cuts = upto[np.searchsorted(starts, np.append(0, np.cumsum([len(x) + 1 for x in run])))].tolist()
        return [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _encode_odd(self, text: str) -> np.ndarray:
        """A text with runs of spaces, or with the mark as a letter."""
        row = UNIT.findall(MARK + text.replace(" ", MARK))
        self._ready(list(set(row)))
        return np.frombuffer(b"".join([self.known[u] for u in row]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: piece marks become spaces, the first space is the model's own."""
        table = self.bytes_of
        data = b"".join([table[i] for i in ids.tolist()])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


KEEPS = "sentencepiece "


def codec(model_file: str) -> Codec:
    return kept(f"{KEEPS}{model_file}", lambda: Codec(model_file))


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, ids_crc32, round_trip) for every row.

    ids are those of the model; ids_crc32 is over them as little-endian 32-bit integers; round_trip
    tells whether decoding gives the text again (the mark U+2581 in a text decodes as a space, as in the
    model). Null and empty texts have no ids. Null and repeated ids are kept row by row, other
    columns are ignored, an empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        try:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                lo = 0
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= TEXT_SPAN):
                        size += len(texts[hi] or "")
                        hi += 1
                    arrays = own.encode(texts[lo:hi])
                    sizes = np.array([len(a) for a in arrays], np.int64)
                    back = [own.decode(a) == (t or "").replace(MARK, " ") for a, t in zip(arrays, texts[lo:hi], strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(arrays)))
                    columns = [batch.column(0).slice(lo, hi - lo), lists, pa.array(sizes), pa.array([zlib.crc32(a.astype("<i4").tobytes()) for a in arrays], pa.int64()), pa.array(back)]
                    yield pa.record_batch(columns, [id_col, "ids", "n_tokens", "ids_crc32", "round_trip"])
                    lo = hi
        finally:  # a process that waits for its next task holds no units: there may be more of them than cores
            own.forget()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(tidy(work, KEEPS), f"`{id_col}` long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")
