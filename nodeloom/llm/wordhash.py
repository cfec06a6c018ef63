"""Words and word shingles of many texts at once, as 64-bit hashes in NumPy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; as these are
ASCII, working on UTF-8 bytes equals working on code points. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space is 0x20 alone.
BLANK = np.zeros(256, bool)
BLANK[0x20] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240511).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: The bits of a block's first bytes, by how many of its bytes a word has.
_BLOCK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of so many bytes get a cryptographic hash: the sums below can be made to agree for two long words.
LONG = 24
#: Text bytes worked on at once (a longer text is worked on alone).
SPAN = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        for key, base in (("up", _MUL), ("down", _INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POW[key] = np.cumprod(steps, dtype=np.uint64)
    return _POW["up"][:n], _POW["down"][:n]


def spans(texts: list[str | bytes | None], most: int = SPAN) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) for runs of texts of about ``most`` bytes."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text if isinstance(text, bytes) else text.encode() if text else b""
        if run and size + len(data) > most:
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def scan(raw: bytes, white: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of ``raw``, which ends with white space; nothing is lower-cased."""
    buf = np.frombuffer(raw, np.uint8)
    space = white[buf]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts >= LONG)
    if len(long):
        at = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        hashes[long] = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in at]), "<u8")
    return hashes, starts, ends


def scan_blocks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``raw``, which ends with white space; nothing is lower-cased.

    Words are read as at most three blocks of eight bytes: the work per byte is the search for white space alone. Longer words
    get a cryptographic hash, as in ``scan``; the hashes of the two are not the same.
    """
    space = np.frombuffer(raw.translate(_SPACE.tobytes()), bool)
    edge = np.empty_like(space)
    edge[0], edge[1:] = not space[0], space[1:] != space[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    sizes = ends - starts
    blocks = np.ndarray(len(raw) + LONG - 8, "<u8", raw + bytes(LONG), strides=(1,))
    hashes = mix((blocks[starts] & _BLOCK[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _MUL)
    for k in range(8, LONG, 8):
        more = np.flatnonzero(sizes > k)
        hashes[more] = mix(hashes[more] + (blocks[starts[more] + k] & _BLOCK[np.minimum(sizes[more] - k, 8)]))
    for i in np.flatnonzero(sizes >= LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return hashes, starts


def distinct_words(raw: bytes, white: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word of ``raw``, which ends with white space, an occurrence of each distinct word, and its number for every word.

    Words are grouped by hash and then compared byte by byte, so no two different words are taken for one.
    """
    hashes, starts, ends = scan(raw, white)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(starts):
        return starts, ends, first, inverse
    buf, sizes = np.frombuffer(raw, np.uint8), ends - starts
    same = sizes == sizes[first][inverse]
    again = np.flatnonzero(same & (np.arange(len(starts)) != first[inverse]))
    if len(again):
        own = sizes[again]
        heads = np.cumsum(own) - own
        at = np.arange(own.sum()) + np.repeat(starts[again] - heads, own)
        differ = buf[at] != buf[at + np.repeat(starts[first][inverse[again]] - starts[again], own)]
        if differ.any():
            same[again[np.logical_or.reduceat(differ, heads)]] = False
    if not same.all():
        extra: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~same).tolist():
            word = raw[starts[i] : ends[i]]
            if word not in extra:
                extra[word] = len(first) + len(more)
                more.append(i)
            inverse[i] = extra[word]
        first = np.append(first, more)
    return starts, ends, first, inverse


def words(run: list[bytes], split: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of its text in ``run``, index of its line in the text).

    Lines are told apart only if ``split`` (one byte) is given.
    """
    raw = b"\n".join(run) + b"\n"
    hashes, starts, _ = scan(raw.lower())
    offsets = np.zeros(len(run), np.int64)
    offsets[1:] = np.cumsum([len(x) + 1 for x in run])[:-1]
    text = np.searchsorted(offsets, starts, "right") - 1
    line = np.zeros(len(starts), np.int64)
    if split is not None:
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == split[0])
        at = np.searchsorted(breaks, starts)
        line = at - np.searchsorted(breaks, offsets)[text]
    return hashes, text, line


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words, but some, has its whole sequence as the only shingle.
    """
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for _, run in spans(texts):
        hashes, text, _ = words(run)
        edge = np.searchsorted(text, np.arange(len(run) + 1))
        n = max(0, len(hashes) - width + 1)
        sums = np.zeros(n, np.uint64)
        for k in range(width):
            sums += hashes[k : k + n] * factor[k]
        sums = mix(sums)
        for i in range(len(run)):
            lo, hi = edge[i], edge[i + 1]
            if hi - lo >= width:
                yield np.unique(sums[lo : hi - width + 1])
            elif hi > lo:
                yield mix(np.array([(hashes[lo:hi] * factor[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def jaccard_sizes(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
