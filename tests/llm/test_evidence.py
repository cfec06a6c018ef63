"""Plain solutions beside operators that SQL cannot express: the mix's dual, and the stored form and feature of media."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import zstandard
from pyspark.sql import functions as F

from nodeloom.llm import media_chunks, mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(totals):
    """Sources in order, null last, weigh 5, 2, 1; what a cap of twice the size turns away is shared again by weight."""
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(totals.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * totals[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 2 * totals[s]
            left -= target[s]
        free -= full
    return target


def plain_tilt(sizes, target):
    """By halving: the tilt at which the tilted rates take the target's words."""
    sizes = np.array(sizes, float)
    scale, lo, hi = sizes.max(), -1e6, 1e6
    words = lambda t: (sizes * np.minimum(2, np.exp(np.minimum(50, t * sizes / scale)))).sum()
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
    return (lo + hi) / 2


def check_mix(spark, docs):
    rows = docs.select("doc_id", "source", "text", F.pmod(F.xxhash64("doc_id", F.lit(20240511)), F.lit(mixing.UNIT)).alias("offset")).collect()
    sizes = defaultdict(list)
    for r in rows:
        sizes[r.source].append((r.doc_id, len(WORD.findall(r.text or "")), r.offset))
    totals = {s: sum(n for _, n, _ in own) for s, own in sizes.items()}
    targets = plain_targets(totals)
    table = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = {r.source: r for r in mixing.mixing_plan(table).collect()}
    source, taken = {r.doc_id: r.source for r in rows}, Counter()
    for r in mixing.mix(docs).collect():
        taken[source[r.doc_id]] += r.taken
    for s, own in sizes.items():
        assert math.isclose(plan[s].target, targets[s], rel_tol=1e-9)
        if not totals[s] or targets[s] >= 2 * totals[s]:
            assert plan[s].tilt is None and taken[s] == 2 * totals[s]
            continue
        words = [n for _, n, _ in own if n]
        tilt = plain_tilt(words, targets[s])
        scale = max(words)
        rate = lambda t: [min(2, math.exp(t * n / scale)) for n in words]  # noqa: B023, E731
        assert np.allclose(rate(plan[s].tilt), rate(tilt), atol=2e-5)
        # copies by the threshold that comes nearest
        steps = Counter()
        for _, n, offset in own:
            if n:
                level = int(min(2.0, math.exp(plan[s].tilt * n / scale)) * mixing.UNIT) + offset
                for k in (1, 2):
                    steps[k * mixing.UNIT - level] += n
        sums = np.cumsum([steps[t] for t in sorted(steps)])
        best = np.abs(np.append(0, sums) - targets[s]).min()
        assert abs(taken[s] - targets[s]) <= best + 1e-6


def test_the_mix_equals_an_independent_solution_of_the_dual(spark):
    check_mix(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_the_mix_with_a_hot_source_null_sources_and_a_very_long_text(spark):
    rng = np.random.default_rng(11)
    rows = [(i, ("hot", "a", None, "b", "tiny")[min(4, int(rng.geometric(0.5)) - 1)], " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(400)]
    rows += [(1000, "b", "w " * 1_500_000), (1001, "empty", None), (1002, "empty", "")]
    check_mix(spark, spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3))


def test_media_equal_a_plain_version(spark):
    rng = np.random.default_rng(12)
    words = [f"w{x}é" for x in rng.integers(0, 3000, 400_000)]
    texts = [None, "", "short", " ".join(words), " ".join(words[:5000]), " ".join(words[2000:9000]), "x" * 100_000, " ".join(words[:5000])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for r in media_chunks.media(table).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        frames, lo = [], 0
        for hi in media_chunks.cut_points(payload):
            assert hi - lo <= 16384
            frames.append(pack.compress(payload[lo:hi]))
            lo = hi
        stored = b"".join(frames)
        assert (r.media_bytes, r.media_sha256, r.n_chunks) == (len(stored), hashlib.sha256(stored).hexdigest(), len(frames))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        share = {b: n / len(payload) for b, n in Counter(payload).items()}
        mean = sum(b * p for b, p in share.items())
        plain = (mean, math.sqrt(sum(p * (b - mean) ** 2 for b, p in share.items())), -sum(p * math.log2(p) for p in share.values()), max(share.values()))
        found = [float(x.split("=")[1]) for x in r.feature.split(";")]
        assert np.allclose(found[:4], plain, atol=2e-6) and found[4] == len(payload)
