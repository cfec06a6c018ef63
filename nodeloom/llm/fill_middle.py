"""Fill-in-middle: texts are cut into prefix, middle and suffix at word boundaries and put in another order.

A token is white space with the word behind it, or the white space at a text's end. The kernel works on the UTF-8
buffer of an Arrow batch, for many rows together: a table gives each byte's class, a byte and its neighbour say
where a token ends, sums that start anew with each document number the tokens, and ``searchsorted`` finds the cuts of all
rows. Only positions are computed per row; bytes are copied by one gather.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import free_name, give_back, once

#: Marks in front of prefix, suffix and middle; texts that hold one stay plain. Fixed values.
MARKS = (b"<P>", b"<S>", b"<M>")
FORMS = ("plain", "psm", "spm")
#: Text bytes that the kernel works on at once (a longer text is worked on alone).
SPAN = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = np.zeros(256, bool)
_MARK[[mark[1] for mark in MARKS]] = True
_SCHEMA = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"
_TYPE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _upto(flags: np.ndarray) -> np.ndarray:
    """How many flags are set in front of each position, and in all."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def holds_mark(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row whether a mark is in it."""
    out = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero((data[:-2] == 0x3C) & _MARK[data[1:-1]] & (data[2:] == 0x3E))
    row = np.searchsorted(offsets, at, "right") - 1
    out[row[at + 3 <= offsets[row + 1]]] = True  # not across two rows
    return out


def transform(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, percent: int, spm_percent: int) -> pa.StructArray:
    """The rows of a UTF-8 buffer (row i: data[offsets[i]:offsets[i + 1]]) with their four draws, transformed."""
    starts, stops = offsets[:-1], offsets[1:]
    rows, filled = len(starts), stops > starts
    white = _WHITE[data]
    edge = ~white
    edge[:-1] &= white[1:]  # a word's last byte
    edge[stops[filled] - 1] = True  # and a text's
    tokens, chars = _upto(edge), _upto((data & 0xC0) != 0x80)
    n = (tokens[stops] - tokens[starts]).astype(np.int64)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    # the token numbered k of a document ends where the sum over the buffer first reaches k and the tokens before the document
    ends = np.searchsorted(tokens, tokens[starts][:, None] + cuts, "left")
    ends = np.where(cuts == 0, starts[:, None], ends)
    first, second = ends[:, 0], ends[:, 1]
    moved = filled & (draws[:, 2] % 100 < percent) & ~holds_mark(data, offsets)
    form = np.where(moved, np.where(draws[:, 3] % 100 < spm_percent, 2, 1), 0)
    marks = len(data) + np.arange(3) * len(MARKS[0])  # they stand behind the texts
    p, s, m = ((np.full(rows, at), np.full(rows, len(mark))) for at, mark in zip(marks, MARKS, strict=True))
    prefix, middle, suffix = (starts, first - starts), (first, second - first), (second, stops - second)
    order = {1: (p, prefix, s, suffix, m, middle), 2: (s, suffix, p, prefix, m, middle)}
    begin, size = np.zeros((rows, 6), np.int64), np.zeros((rows, 6), np.int64)
    begin[:, 0], size[:, 0] = starts, stops - starts
    for which, pieces in order.items():
        own = form == which
        for k, (at, length) in enumerate(pieces):
            begin[own, k], size[own, k] = at[own], length[own]
    total = np.append(0, np.cumsum(size.sum(1)))
    place = (np.cumsum(size) - size.ravel()).astype(np.int64)
    gather = np.arange(total[-1]) + np.repeat(begin.ravel() - place, size.ravel())
    out = np.concatenate([data, np.frombuffer(b"".join(MARKS), np.uint8)])[gather]
    output = pa.StringArray.from_buffers(rows, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(out))
    lengths = [pa.array((chars[b] - chars[a]).astype(np.int64), mask=~moved) for a, b in ((starts, first), (first, second))]
    return pa.StructArray.from_arrays([pa.array(n), pa.array(FORMS).take(pa.array(form)), *lengths, output], fields=list(_TYPE))


def transformed(text: pa.Array, draws: np.ndarray, percent: int, spm_percent: int, span: int = SPAN) -> pa.Array:
    """The struct of ``transform`` for each row of an Arrow array (null: empty), by runs of about ``span`` bytes."""
    text = text.fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    parts, lo = [], 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + span, "right")) - 1)
        parts.append(transform(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], draws[lo:hi], percent, spm_percent))
        lo = hi
    return pa.concat_arrays(parts) if parts else pa.array([], _TYPE)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs plus n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    About ``percent`` of the documents are moved, ``spm_percent`` of these with the suffix first; a hash of seed and id draws
    form and cuts, so reruns and rows that share an id (a null one counts as empty) draw alike. Null texts count as empty; texts
    that are empty or hold a mark stay plain. Each row stands alone: repeated rows give repeated results, an empty table an
    empty one. Other columns pass unchanged; where docs has a column of a result's name, the new one gets underscores
    behind its name until it is free. No row moves to another task.
    """
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]

    @F.arrow_udf(_SCHEMA)
    def work(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, *drawn in batches:
            yield transformed(text, np.stack([d.to_numpy(zero_copy_only=False) for d in drawn], 1), percent, spm_percent)
        give_back()

    made = free_name(docs, "_made")
    out = docs.withColumn(made, once(work)(F.col(text_col), *draws))
    taken = docs
    names = {}
    for c in ("n", "form", "prefix_chars", "middle_chars", "output"):
        names[c] = free_name(taken, c)
        taken = taken.withColumn(names[c], F.lit(None))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{made}.{c}").alias(name) for c, name in names.items()))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from, by its form alone: a moved text holds each mark once."""
    part = lambda k: F.split(output, "<[PSM]>", -1)[k]
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
