"""Exact top-k search, periodic runs and fill-in-middle against brute force, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import exact_topk, fill_middle, periodic_runs, queries

# --- exact top-k

VECTORS = "vec_id long, embedding array<double>, rank int, vector string, size long"


def integers(vector):
    return [math.floor(256 * x) for x in vector]


def brute_top(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in dict.fromkeys((i, tuple(v)) for i, v in ok if i % 50 == 0):
        rest = list(ok)
        rest.remove((i, list(v)))
        scores = sorted((-min(max(sum(a * b for a, b in zip(integers(v), integers(w), strict=True)), -(2**63 - 1)), 2**63 - 1), j) for j, w in rest if len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return Counter(out)


def found_top(spark, rows, k=5):
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    return Counter(map(tuple, exact_topk.top_k(table, F.col("vec_id") % 50 == 0, k).collect()))


def test_top_k_with_ties_repeats_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(230)]
    rows += [(i, [0.5] * 6) for i in range(300, 340)]  # ties: one vector many times, a query among them
    rows += [(350, [0.5] * 6), (350, [0.5] * 6), (350, [0.25] * 6)]  # rows that share an id, two of them equal
    rows += [(400, None), (450, [None] * 6), (500, [float("nan")] * 6), (550, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(600, [1.0, -1.0]), (601, [2.0, 0.1]), (602, [-0.001, 0.0]), (650, []), (651, []), (700, [3.0] * 9)]  # other lengths
    assert found_top(spark, rows) == brute_top(rows, 5)
    assert found_top(spark, rows, 1) == brute_top(rows, 1)


def test_top_k_of_an_empty_table_and_of_one_without_queries(spark):
    assert found_top(spark, []) == Counter()
    assert found_top(spark, [(1, [1.0]), (2, [1.0])]) == Counter()


@pytest.mark.parametrize("scale", [1e3, 1e7, 1e12, 1e300])
def test_top_k_of_large_components(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=4) * scale]) for i in range(101)]
    assert found_top(spark, rows) == brute_top(rows, 5)


def test_many_tiles_and_levels_of_merging(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=3)]) for i in range(400)]
    for name, value in {"BLOCK_BYTES": 64, "SHARD": 7, "SPREAD": 2, "FAN": 3, "ROWS": 5}.items():
        monkeypatch.setattr(exact_topk, name, value)
    assert found_top(spark, rows) == brute_top(rows, 5)


# --- periodic runs


def brute_runs(words, least=12):
    """Maximal stretches of every period that no smaller one has."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def run_texts():
    rng = np.random.default_rng(6)
    draw = lambda n, k: [f"w{x}" for x in rng.integers(0, k, n)]
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1].split()) < 300:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    phrase, long = draw(9, 50), draw(170, 30)
    texts = [None, "", " \n\t ", "one", "x " * 11, "x " * 12, "\x0bx\x0c" * 40, " ".join(thue_morse(900)), fibonacci[-1]]
    texts += [" ".join([*draw(20, 9), *phrase * 3, *phrase[:4], *draw(20, 9)]), " ".join(long * 2), " ".join(long * 2 + long[:90] + draw(40, 9) + ["y"] * 30)]
    texts += [" ".join(draw(400, 2)), " ".join(draw(400, 3)), "a b é é " * 8, "A a " * 6 + "a A " * 6, " ".join(["z"] * 3000)]
    return texts + texts[9:12]


def test_periodic_runs_equal_brute_force(spark):
    texts = run_texts()
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n_words int")
    out = {r.doc_id: r for r in periodic_runs.with_runs(table).collect()}
    for i, t in enumerate(texts):
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        expected = brute_runs(words)
        assert out[i].n_words_ == len(words) and out[i].n_words == 1 and out[i].runs == "clash"
        assert [tuple(r) for r in out[i].runs_] == expected
        assert out[i].collapsed == collapsed(words, expected)


def test_run_digest_of_planted_tails(spark):
    texts = run_texts() * 8
    ids = [None, *range(1000, 1000 + len(texts) - 1)]
    out = periodic_runs.run_digest(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
    got, planted = Counter(map(tuple, out)), 0
    expected = Counter()
    for doc, t in zip(ids, texts, strict=True):
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected[(doc, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())] += 1
    assert got == expected and planted > 5


def test_hashes_that_deceive_are_found_out(spark):
    """A sequence of two words on which polynomial hashes modulo 2**64 agree by construction: exact names take over."""
    words = thue_morse(1 << 12)
    other = [{"a": "b", "b": "a"}[w] for w in words]
    ids = np.array([w == "b" for w in words + other + words], np.int64)
    size = np.array([len(words)])
    assert periodic_runs.Hashes(ids).same(np.array([0]), size, size)[0]
    assert not periodic_runs.Names(ids, len(ids)).same(np.array([0]), size, size)[0]
    plain = [tuple(r) for r in periodic_runs.runs_of(ids, np.array([0, len(ids)]))]
    exact = [tuple(r) for r in periodic_runs._found(periodic_runs.Names(ids, len(ids)), np.array([0]), np.array([len(ids)]), 12)]
    assert plain == exact
    assert all((ids[s : e - q] == ids[s + q : e]).all() for s, e, q in plain)


def test_names_and_small_arrays_give_the_same_runs(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    for text in run_texts():
        words = (text or "").split()
        ids = np.array([sorted(set(words)).index(w) for w in words], np.int64)
        if len(ids) < 1200 and len(ids):
            expected = [(s, s + n, q) for s, n, q in brute_runs(words)]
            offsets = np.array([0, len(ids)])
            assert [tuple(r) for r in periodic_runs.runs_of(ids, offsets)] == expected
            assert [tuple(r) for r in periodic_runs._found(periodic_runs.Names(ids, len(ids)), offsets[:-1], offsets[1:], 12)] == expected


def test_a_text_of_several_megabytes(spark):
    rng = np.random.default_rng(7)
    unit = [f"w{x}" for x in rng.integers(0, 5000, 100_000)]
    words = [f"v{x}" for x in rng.integers(0, 5000, 200_000)] + unit * 2 + unit[:10]
    row = periodic_runs.with_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (200_000, 200_010, 100_000) in [tuple(r) for r in row.runs]
    assert row.collapsed == collapsed(words, [tuple(r) for r in row.runs])


# --- fill in the middle

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_middle(doc, text, percent=50):
    text = text or ""
    tokens = TOKEN.findall(text)
    hexed = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def middle_texts():
    rng = np.random.default_rng(8)
    odd = [None, "", " ", "\n\t ", "word", " word", "word ", "a b", " a  b\x0bc\x0c", "é ü 漢字 𝔘 ", "x y　z", "a <P> b", "<S>", "b<M>", "<P", ">", "<P <S M>", "a<", "P>b", "<Q> x", "\x00 nul \x1f b"]
    return odd + [" ".join(f"w{x}é" for x in rng.integers(0, 99, int(n))) for n in rng.integers(1, 60, 40)] + ["long 漢 text\n" * 200_000]


@pytest.mark.parametrize("percent", [50, 100])
def test_fill_middle_equals_brute_force_and_is_restored(spark, percent):
    rows = [(None if i == 30 else i % 70, t, "clash") for i, t in enumerate(middle_texts() * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = fill_middle.fill_middle(table, percent=percent)
    out = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form_")))
    got = out.collect()
    assert Counter((r.doc_id, r.n, r.form_, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((d, *brute_middle(d, t, percent)) for d, t, _ in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((d, t or "") for d, t, _ in rows)
    assert {r.form for r in got} == {"clash"} and {r.form_ for r in got} == {"plain", "spm", "psm"}


def test_fill_middle_of_sliced_arrays_and_short_runs():
    import pyarrow as pa

    texts = middle_texts()[:-1]
    draws = np.random.default_rng(9).integers(0, 1 << 32, (len(texts), 4))
    whole = fill_middle.transformed(pa.array(texts), draws, 80, 50)
    for span in (1, 40, 1000):
        assert fill_middle.transformed(pa.array(["before", *texts, "after"]).slice(1, len(texts)), draws, 80, 50, span) == whole
        assert fill_middle.transformed(pa.array(texts, pa.large_string()), draws, 80, 50, span) == whole


def test_empty_tables(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.fill_middle(table).count() == 0 and periodic_runs.with_runs(table).count() == 0 and periodic_runs.run_digest(table).count() == 0
    assert {"op11_exact_topk", "op12_periodic_runs", "op13_fill_middle"} <= set(queries.queries()) & set(queries.oracle_sql())
