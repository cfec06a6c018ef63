"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of a text, one of toxic and one of ordinary documents, have their own counts
of n-grams and share all lower orders: interpolated Kneser-Ney continuation counts over both
classes. A rare expression is thus judged by the point where it leaves what its class has shown, and
otherwise by what both classes share. Words are parted by one gap letter, and the n-grams run across it.
A document's features are its log-likelihood ratio per word (length-normalised), that of its most toxic window, and those
of its ``TOP`` most toxic words one by one; a logistic regression fitted to out-of-fold features makes them a probability.

Labels are learned from a bounded sample: the ``PER_CLASS`` labelled documents of each class with the smallest hash of
the id, as long as they hold at most ``CHARACTERS`` together. A document of more than a ``SHARE``-th of these characters is left out by
itself and does not count, so no text keeps others out; ``Model.left_out`` has the number of all that were left out. All n-grams of the sample count, those of one document too: the continuation counts and discounts rest on them.
The bound is also that of the model, which travels with the tasks. Scoring reads whole texts. How many top words are features, and
the discount, are picked by the loss over the folds of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import Scratch, free_name, give_back, once, tidy

#: Most letters in an n-gram, documents learned per class and their characters, folds, words in a window.
ORDER, PER_CLASS, CHARACTERS, FOLDS, WINDOW = 6, 4000, 16_000_000, 4, 12
#: A document of more than this part of the characters is not learned from.
SHARE = 64
#: Discounts of the classes' own counts that are tried; out-of-fold loss decides.
DISCOUNTS = (0.8, 2.0, 4.0, 8.0)
#: The most of a count that a discount takes, so that n-grams of few documents, even of one, keep a part.
MOST = 0.8
#: Most toxic words of a text that are measured, how many of them are tried as features, and characters worked on at once.
TOP, TOPS, SPAN = 5, (1, 2, 3, 4, 5), 1 << 19
#: Numbers of the gap in front of the first word, between words, and of letters that the sample does not have.
GAP, OTHER = 1, 2
_WORD = np.array([chr(c).isalnum() for c in range(0x3000)])


class Letters:
    """Numbers for the sample's letters: each has its own, so no two are taken for one.

    Keys of n-grams have 62 bits; a large alphabet needs more bits a letter and gets shorter n-grams.
    """

    def __init__(self, codes: list[int]) -> None:
        self.codes = np.array(sorted(codes), np.int64)
        self.bits = (len(codes) + 3).bit_length()
        self.order = max(2, min(ORDER, 62 // self.bits))
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def of(self, codes: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.full(0x110000, OTHER, np.int32)
            self._table[self.codes] = np.arange(len(self.codes)) + 3
        return self._table[codes]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, word starts, word ends, text of each word) of the lower-cased texts."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = _WORD[np.minimum(codes, len(_WORD) - 1)] | (codes >= len(_WORD))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.append(0, np.cumsum([len(t) + 1 for t in low])[:-1])
    return codes, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _grams(letters: Letters, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, first key of each word): one key for each letter of each word and for the gap behind it.

    ``before`` has, per word, where the word in front of it ends and starts: its last letters and a gap are the first context.
    """
    order, sizes = letters.order, ends - starts
    back = order - 1
    heads = np.append(0, np.cumsum(sizes + back + 1))[:-1]
    flat = np.full(int((sizes + back + 1).sum()), GAP, np.int64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[np.repeat(heads, sizes) + back + within] = letters.of(codes[np.repeat(starts, sizes) + within])
    for k in range(2, back + 1):  # the letters in front of the gap
        own = np.flatnonzero(before[:, 0] - before[:, 1] >= k - 1)
        flat[heads[own] + back - k] = letters.of(codes[before[own, 0] - (k - 1)])
    inside = np.ones(len(flat), bool)
    for k in range(back):
        inside[heads + k] = False
    at = np.flatnonzero(inside)
    keys = np.zeros(len(at), np.int64)
    for k in range(order):
        keys = (keys << letters.bits) | flat[at - back + k]
    return keys, np.append(0, np.cumsum(sizes + 1))[:-1]


def _before(starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(end, start) of the word in front of each word; both 0 for the first one of a text."""
    out = np.zeros((len(starts), 2), np.int64)
    out[1:, 0], out[1:, 1] = ends[:-1], starts[:-1]
    out[np.append(True, text[1:] != text[:-1])] = 0
    return out


@dataclass
class Ratios:
    """Log-likelihood ratios: of seen n-grams, and of contexts for letters not seen there."""

    letters: Letters
    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for table, values, want in ((self.contexts, self.context_ratio, keys >> self.letters.bits), (self.keys, self.ratio, keys)):
            if len(table):
                at = np.minimum(np.searchsorted(table, want), len(table) - 1)
                hit = table[at] == want
                out[hit] = values[at[hit]]
        return out


def _discount(counts: np.ndarray) -> float:
    """The usual estimate for the shared orders."""
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))


def _shared(keys: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Interpolated Kneser-Ney probabilities, from distinct n-grams of ``order`` + 1, of their last letter after order - 1 letters."""
    mask = (1 << (bits * order)) - 1
    grams, counts = np.unique(np.unique(keys) & mask, return_counts=True)
    if order == 1:
        lower = np.full(len(grams), 1.0 / (len(grams) + 1))
        contexts = np.zeros(len(grams), np.int64)
    else:
        lower = _shared(grams, order - 1, bits)
        contexts = grams >> bits
    d = _discount(counts)
    which = np.unique(contexts, return_inverse=True)[1]
    totals, types = np.bincount(which, counts)[which], np.bincount(which)[which]
    own = (np.maximum(counts - d, 0) + d * types * lower) / totals
    return own[np.searchsorted(grams, keys & mask)]


def fit_ratios(letters: Letters, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, discounts: tuple[float, ...]) -> list[Ratios]:
    """The models' ratios, for each discount, from the documents of the two classes that hold each n-gram (sorted keys)."""
    seen = toxic + ordinary > 0
    keys, counts = keys[seen], (toxic[seen], ordinary[seen])
    if not len(keys):
        return [Ratios(letters, *(np.zeros(0) for _ in range(4)))] * len(discounts)
    lower = _shared(keys, letters.order - 1, letters.bits)
    contexts, which = np.unique(keys >> letters.bits, return_inverse=True)
    out = []
    for d in discounts:
        logs, spare = [], []
        for c in counts:
            less = np.minimum(MOST * c, d)
            totals, cut = np.bincount(which, c), np.bincount(which, less)
            weight = np.where(totals > 0, cut / np.maximum(totals, 1), 1.0)
            spare.append(np.log(weight))
            logs.append(np.log((c - less) / np.maximum(totals, 1)[which] + weight[which] * lower))
        out.append(Ratios(letters, keys, (logs[0] - logs[1]).astype(np.float32), contexts, (spare[0] - spare[1]).astype(np.float32)))
    return out


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SPAN):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def features(texts: list[str | None], models: list[Ratios]) -> list[np.ndarray]:
    """Per model and text: mean ratio per word, the best window's, those of the ``TOP`` best words, log of the number of words."""
    texts = [t or "" for t in texts]
    out = [np.zeros((len(texts), TOP + 3)) for _ in models]
    for lo, hi in _runs(texts):
        codes, starts, ends, text = _words(texts[lo:hi])
        if not len(starts):
            continue
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        own = lo + text[heads]
        n = np.diff(np.append(heads, len(text)))
        stop = np.minimum(np.arange(len(text)) + WINDOW, np.repeat(np.append(heads[1:], len(text)), n))
        keys, first = _grams(models[0].letters, codes, starts, ends, _before(starts, ends, text))
        distinct, inverse = np.unique(keys, return_inverse=True)
        for model, rows in zip(models, out, strict=True):
            word = np.add.reduceat(model.of(distinct)[inverse], first)
            sums = np.append(0.0, np.cumsum(word))
            rows[own, 0] = np.add.reduceat(word, heads) / n
            rows[own, 1] = np.maximum.reduceat((sums[stop] - sums[:-1]) / WINDOW, heads)
            down = word[np.lexsort((-word, text))]
            for k in range(TOP):  # a text of fewer words has the last one again
                rows[own, 2 + k] = down[heads + np.minimum(k, n - 1)]
            rows[own, -1] = np.log1p(n)
    return out


def with_top(x: np.ndarray, top: int) -> np.ndarray:
    """The features with only the first ``top`` of the most toxic words."""
    return np.delete(x, range(2 + top, 2 + TOP), axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, scales) of a ridge logistic regression with both classes weighing the same."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    ridge = np.diag([0.0] + [1.0] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - ridge @ w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def probability(x: np.ndarray, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + (x - mean) / scale @ weights[1:], -30, 30)))


@dataclass
class Model:
    ratios: Ratios | None
    fitted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    top: int = TOP
    left_out: int = 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.ratios is None:
            return np.zeros(len(texts))
        return probability(with_top(features(texts, [self.ratios])[0], self.top), *self.fitted)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, characters: int = CHARACTERS) -> DataFrame:
    """(id, text, toxic, fold, taken) of at most per_class labelled documents of each class that are not held out.

    Those taken have at most ``characters`` together; the others' texts are null. A document with more than a ``SHARE``-th of
    ``characters`` is not taken and does not count, so what is taken fills them nearly before the others are left out.

    A document with several labels counts as toxic if any says so; of rows that share an id one counts. At most 2 * per_class
    ids are broadcast.
    """
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    rows = rows.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    parts = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    found = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(parts[0].union(parts[1])), "id")
    found = found.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size = F.length("text")
    fits = size <= characters // SHARE
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")  # per_class rows at most
    found = found.withColumn("taken", fits & (F.sum(F.when(fits, size).otherwise(0)).over(before) <= characters))
    text = F.when(F.col("taken"), F.col("text"))
    return found.select("id", text.alias("text"), F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"), "taken")


def _letters(sample: DataFrame) -> Letters:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _runs(texts):
                codes, starts, ends, _ = _words(texts[lo:hi])
                inside = np.zeros(len(codes) + 1, np.int64)
                inside[starts] += 1
                inside[ends] -= 1
                yield pa.record_batch([pa.array(np.unique(codes[np.cumsum(inside)[:-1] > 0]))], ["code"])

    return Letters([r.code for r in sample.select("text").mapInArrow(tidy(work), "code long").distinct().collect()])  # code points: 1,114,112 at most


def _counts(sample: DataFrame, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(sorted n-gram keys, documents that hold each, by class and fold)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            cell = batch.column("toxic").to_numpy() * FOLDS + batch.column("fold").to_numpy()
            for lo, hi in _runs(texts):
                codes, starts, ends, text = _words(texts[lo:hi])
                if not len(starts):
                    continue
                keys, first = _grams(letters, codes, starts, ends, _before(starts, ends, text))
                cuts = np.append(first, len(keys))[np.searchsorted(text, np.arange(hi - lo + 1))]
                held: dict[int, list[np.ndarray]] = {}
                for i in range(hi - lo):
                    if cuts[i] < cuts[i + 1]:
                        held.setdefault(int(cell[lo + i]), []).append(np.unique(keys[cuts[i] : cuts[i + 1]]))
                for c, parts in held.items():
                    distinct, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.record_batch([pa.array(distinct), pa.array(np.full(len(distinct), c, np.int32)), pa.array(n.astype(np.int32))], ["key", "cell", "n"])

    rows = sample.select("text", "toxic", "fold").mapInArrow(tidy(count), "key long, cell int, n int")
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).cast("int").alias(f"c{c}") for c in range(2 * FOLDS)]
    table = rows.groupBy("key").agg(*cells).toArrow()  # the n-grams of the bounded sample
    keys = table.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.stack([table.column(f"c{c}").to_numpy()[order] for c in range(2 * FOLDS)]).reshape(2, FOLDS, -1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, characters: int = CHARACTERS) -> Model:
    """Count n-grams over the sample, fit the models of each fold's rest, then those of the whole sample."""
    tables = Scratch(docs.sparkSession, "toxicity")
    chosen = tables.store(training_sample(docs, labels, per_class, characters), "sample")
    sample, left_out = chosen.where("taken"), chosen.where("not taken").count()
    letters = _letters(sample)
    keys, counts = _counts(sample, letters)
    if not (counts.sum((1, 2)) > 0).all():
        tables.drop()
        return Model(None, left_out=left_out)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, models = None, []
        for batch in batches:
            folds, texts, toxic = batch.column("fold").to_numpy(), batch.column("text").to_pylist(), batch.column("toxic").to_numpy()
            for k in np.unique(folds):
                own = np.flatnonzero(folds == k)
                if now != k:
                    rest = counts.sum(1, dtype=np.int64) - counts[:, k]
                    now, models = k, fit_ratios(letters, keys, rest[1], rest[0], DISCOUNTS)
                for which, x in enumerate(features([texts[i] for i in own], models)):
                    yield pa.record_batch([pa.array(np.full(len(own), which, np.int32)), pa.array(toxic[own]), *(pa.array(x[:, j]) for j in range(TOP + 3))], ["d", "y", *names])

    names = [f"f{j}" for j in range(TOP + 3)]
    # one fold a task, so that a task holds the models of one fold
    rows = sample.repartition(FOLDS, "fold").sortWithinPartitions("fold").select("text", "toxic", "fold")
    seen = rows.mapInArrow(tidy(measure), "d int, y int, " + ", ".join(f"{c} double" for c in names)).toPandas()
    seen = seen.sort_values(list(seen.columns))  # rows arrive in any order
    tables.drop()
    best: tuple[float, float, int, tuple] | None = None
    for which, d in enumerate(DISCOUNTS):
        own = seen[seen["d"] == which]
        x, y = own[names].to_numpy(), own["y"].to_numpy()
        for top in TOPS:
            z = with_top(x, top)
            fitted = fit_logistic(z, y)
            p = np.clip(probability(z, *fitted), 1e-9, 1 - 1e-9)
            loss = -(np.log(p[y == 1]).mean() + np.log(1 - p[y == 0]).mean())
            if best is None or loss < best[0]:
                best = (loss, d, top, fitted)
    whole = counts.sum(1, dtype=np.int64)
    model = Model(fit_ratios(letters, keys, whole[1], whole[0], (best[1],))[0], best[3], best[2], left_out)
    del keys, counts, whole, seen
    give_back()
    return model


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(lambda parts: (pd.Series(model.score(part.tolist())) for part in parts))(batches)

    return once(score)(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """docs plus held_out, score (0 to 1) and predicted (score >= threshold).

    Null and empty texts get the score of a text without words. A null id is not held out. Labels that are
    null or not 0 or 1 are ignored; without labels of both classes every score is 0. Rows are scored one
    by one, repeated ones alike; an empty table stays empty; other columns pass unchanged, and if docs has a column of one
    of the three names, the new one gets underscores behind its name until it is free.
    """
    model = fit(docs, labels, per_class)
    names = [free_name(docs, c) for c in ("held_out", "score", "predicted")]
    out = docs.withColumns({names[0]: held_out(F.col("doc_id")), names[1]: score_column(model, F.col("text"))})
    return out.withColumn(names[2], (F.col(names[1]) >= threshold).cast("int"))
