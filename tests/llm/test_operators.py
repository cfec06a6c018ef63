"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import line_dedup, media_chunks, mixing, ngram_join, secret_scan, sentencepiece_codec, token_files, toxicity, vector_neighbors, warc_bundles, wordhash
from nodeloom.llm.queries import TOKENIZERS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tok int"


def sentence(seed, n=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 400, n))


def texts():
    base = sentence(1)
    near = base.replace(base.split()[30], "changed", 1)
    lines = "\n".join([sentence(2, 12), "a shared line of six words", sentence(3, 12), ""])
    return [None, "", "  \n ", base, base, near, sentence(4, 3), sentence(4, 3).upper(), sentence(5, 5000), lines, lines + "\na shared line of six words", "Überß naïve 漢字 𝔘 ▁ mark", base + "\n" + sentence(6, 4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i + 1, t, "en", [None, "a", "b", "c"][i % 4], 0, "clash", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_media_round_trip(docs, empty):
    out = {r.doc_id: r for r in media_chunks.media(docs).collect()}
    for i, t in enumerate(texts()):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = out[i + 1]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert (out[4].media_sha256, out[4].feature) == (out[5].media_sha256, out[5].feature)
    assert media_chunks.media(empty).count() == 0


def test_each_distinct_chunk_is_stored_once(spark, docs, empty):
    from nodeloom.llm.common import scratch

    shared = sentence(7, 4000)
    rows = [(i, shared if i % 3 else sentence(i, 3000) + shared) for i in range(40)] + [(None, None), (None, ""), (3, "x" * 3_000_000)]
    folder = scratch(spark, "test-packs")
    chunks = media_chunks.write_packs(spark.createDataFrame(rows, "id long, text string").repartition(5), folder)
    places = media_chunks.recipes(chunks, media_chunks.write_shared(chunks, folder)).collect()
    cut = [p[a:b] for p in (media_chunks.padded(t)[0] for _, t in rows) for ends in [media_chunks.cut_points(p)] for a, b in zip([0, *ends], ends)]
    distinct = {hashlib.sha256(c).digest() for c in cut}
    frames = {(r.at_pack, r.at_start): (r.digest, r.at_length) for r in places}
    assert len(places) == len(cut) > 2 * len(distinct) and {d for d, _ in frames.values()} == distinct and len(frames) == len(distinct)
    stored = sum(f.stat().st_size for f in Path(folder.removeprefix("file://")).iterdir())
    assert stored == sum(n for _, n in frames.values())
    assert media_chunks.media(empty.select(F.col("doc_id"), "text", F.lit(1).alias("digest"))).count() == 0


def test_chunk_ends_move_with_the_content():
    data = np.random.default_rng(0).integers(0, 256, 100_000, np.uint8).tobytes()
    a, b = set(media_chunks.cut_points(data)), {x - 7 for x in media_chunks.cut_points(b"shifted" + data)}
    assert len(a & b) > 0.8 * len(a) and media_chunks.cut_points(b"x") == [1]


def test_warc(spark):
    big, small = "x" * 1200, "y" * 999
    rows = [(1, "u", big), (2, "u", small), (3, None, big), (4, "u", small), (5, "v", None), (6, "v", ""), (7, "w", "é" * 500), (8, "w", "é" * 500)]
    out = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_bundles.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert out[i][:2] == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: out[i][2:] for i in out} == {1: ("revisit", 3), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 8), 8: ("response", None)}


def test_warc_of_repeated_rows_nulls_and_hot_payloads(spark):
    hot, other = "h" * 5000, "o" * 1000
    rows = [(i, "u", hot, 1) for i in range(300)] + [(299, "v", hot, 1), (None, "n", hot, 1), (None, None, None, 1), (7, "u", other, 1), (7, "u", other, 1), (8, "x" * 9, "y" * 3_000_000, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    out = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_bundles.archived_pages(table).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    top = {t: max(i for i, _, h, _ in rows if h == t and i is not None) for t in (hot, other, "y" * 3_000_000)}
    revisit = lambda i, t: i is not None and len(t or "") >= 1000 and i < top[t]
    assert out == Counter((i, len(t or ""), sha(t), "revisit" if revisit(i, t) else "response", top[t] if revisit(i, t) else None) for i, _, t, _ in rows)
    assert warc_bundles.archived_pages(table.limit(0)).count() == 0


def test_mix(spark, docs, empty):
    rows = [(i, "w " * (1 + i * 7 % 50), ["a", "b", "c", None][i * i % 4 if i % 3 else 0]) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.mix(table.repartition(n)).select("doc_id", "size", "source_size", "target", "taken").collect())) for n in (1, 5))
    assert first == again and len(first) == 400
    source = {i: s for i, _, s in rows}
    sizes = {}
    for d, size, *_ in first:
        sizes[source[d]] = sizes.get(source[d], 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, rest, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= full
    taken = {}
    for d, size, source_size, goal, took in first:
        assert source_size == sizes[source[d]] and goal == pytest.approx(target[source[d]]) and 0 <= took <= 2 * size
        taken[source[d]] = taken.get(source[d], 0) + took
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert mixing.mix(docs).count() == len(texts()) and mixing.mix(empty).count() == 0


def test_mixed_documents_keep_every_column(spark):
    names = ["doc_id", "text", "source", "size", "cut", "target", "tilt", "scale", "source_size", "copies"]
    rows = [(i, "w " * (i % 9), "ab"[i % 2], *range(i, i + 7)) for i in range(60)] + [(None, None, None, *range(7)), (3, "w w", "a", *range(7)), (3, "w w", "a", *range(7))]
    table = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in ('text', 'source') else 'long'}" for c in names))
    out = mixing.mixed_documents(table)
    taken = {r.doc_id: 0 for r in mixing.mix(table).collect()}
    for r in mixing.mix(table).collect():
        taken[r.doc_id] += r.copies
    found = Counter(map(tuple, out.collect()))
    assert out.columns == names and set(found) <= set(rows) and sum(found.values()) == sum(taken.values())
    assert {i: sum(n for r, n in found.items() if r[0] == i) for i in taken} == taken
    assert mixing.mixed_documents(table.limit(0)).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(20, 16))
    rows = [(i, (heads[i % 20] + rng.normal(size=16) * 0.15).tolist(), [0, 1, None][i % 3]) for i in range(300)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], 0)]
    out = {r.vec_id: r for r in vector_neighbors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.float32(v).astype(float), y) for i, v, y in rows if y is not None and i not in (900, 901, 902, 903)]
    links = {(a, b) for a, v, x in good for b, w, y in good if a != b and x == y and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93}
    found = sum(r.n_links for r in out.values())
    assert len(out) == 305 and found <= len(links) and found >= 0.9 * len(links) and len(links) > 100
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values()) and out[904].component_id == out[0].component_id
    assert all(out[i].n_links == 0 for i in (900, 901, 902, 903))


def test_vectors_of_shared_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(vector_neighbors, "BLOCK", 8)  # buckets of several blocks
    rng = np.random.default_rng(4)
    one, two = rng.normal(size=8), rng.normal(size=8)
    near = lambda v, e=0.01: (v + rng.normal(size=8) * e).tolist()
    rows = [(1, near(one), 0, 9.0), (1, near(two), 0, 9.0), (2, near(one), 0, 9.0), (3, near(two), 0, 9.0), (None, near(one), 0, 9.0), (None, None, 0, 9.0), (4, near(one), None, 9.0), (5, [], 0, 9.0)]
    rows += [(20 + i, near(one, 1e-6), 1, 9.0) for i in range(40)] + [(70, rows[0][1], 0, 9.0)]
    out = vector_neighbors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component double")).collect()
    found = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert found == Counter([(1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 1, 1, False), (None, 3, None, False), (None, 0, None, False), (4, 0, 4, True), (5, 0, 5, True), (70, 3, 1, False)] + [(20 + i, 39, 20, i == 0) for i in range(40)])
    assert vector_neighbors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("size", [16, 64, 768])
def test_recall_at_the_threshold(size):
    """Pairs of cosine 0.93: nearly all meet in a bucket that one of them is at home in."""
    rng, n = np.random.default_rng(size), 1000
    a = vector_neighbors.units(rng.normal(size=(n, size)))
    b = rng.normal(size=(n, size))
    b = vector_neighbors.units(b - (a * b).sum(1, keepdims=True) * a)
    p, q = vector_neighbors.buckets(a), vector_neighbors.buckets(vector_neighbors.units(0.93 * a + np.sqrt(1 - 0.93**2) * b))
    assert ((p[:, :, :1] == q).any(2) | (q[:, :, :1] == p).any(2)).any(1).mean() >= 0.97


def groups(sets):
    top = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    return top


def test_ngram_join_against_all_pairs(spark, docs, empty):
    rows = [(t or "") for t in texts()]
    rng = np.random.default_rng(5)
    for k in range(120):  # groups of near copies with more and more changes, and passages that many share
        words = sentence(100 + k % 6, 40 + k % 6 * 10).split()
        for at in rng.integers(0, len(words), k % 5):
            words[at] = f"new{k}"
        rows.append(" ".join(words) + (" a passage of nine words that many documents share" if k % 2 else ""))
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, component string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(table).collect()}
    sets = [shingles(t) for t in rows]
    assert out == {i: (len(s), t) for i, (s, t) in enumerate(zip(sets, groups(sets)))}
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.first_of_each_group(docs).count() == len(set(groups([shingles(t) for t in texts()])))


def test_prefixes_leave_common_shingles_out_where_all_counters_are_full(spark):
    passage = "a passage of twelve words or so that very many documents share"
    rows = [(f"{sentence(k, 150)} {passage} {sentence(1000 + k, 150)}",) for k in range(200)]
    _, common = ngram_join.sketch(spark.createDataFrame(rows, "text string").repartition(3), 5)
    shared = set(next(wordhash.shingle_sets([passage])).tolist())
    full = np.full(1 << ngram_join.BINS_LOG2, 5000)
    for tokens in wordhash.shingle_sets([r[0] for r in rows]):
        _, prefix = ngram_join.prefix_of(tokens, full, common, 5400.0, 80, 100)
        assert shared < set(tokens.tolist()) and not shared & set(prefix.tolist())


def test_blocks_meet_only_where_sizes_can_reach_the_threshold(spark):
    n = spark.range(1, 2001).select(F.col("id").alias("n"), ngram_join.size_class(F.col("id"), 80, 100).alias("scale"))
    scales = {r.n: r.scale for r in n.collect()}
    assert all(scales[m] - scales[k] in (0, 1) for k in scales for m in range(k, min(2000, k * 100 // 80) + 1))
    groups = spark.createDataFrame([(7, scale, ngram_join.OTHERS, 2) for scale in range(10)], "cluster long, scale long, name long, blocks long")
    meets = {}
    for r in ngram_join.meeting_blocks(groups).collect():
        meets.setdefault(r.meet, []).append((r.block.scale, r.block.k))
    assert sorted(map(sorted, meets.values())) == sorted(
        [[(s, k)] for s in range(10) for k in range(2)] + [[(s, 0), (s, 1)] for s in range(10)] + [[(s, k), (s + 1, m)] for s in range(9) for k in range(2) for m in range(2)]
    )


def test_line_dedup_against_all_pairs(docs, empty):
    lines = [(d, k, line) for d, t in enumerate(texts()) for k, line in enumerate((t or "").split("\n"))]
    sets = [shingles(x[2]) for x in lines]
    gone = {(d, k) for i, (d, k, _) in enumerate(lines) if any(sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))}
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in enumerate(texts()):
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        assert (out[d + 1].text, out[d + 1]._removed) == (kept, sum(x == d for x, _ in gone))
    assert line_dedup.dedup_lines(empty).count() == 0


def plain_line_dedup(rows):
    """(id, text, lines removed) of rows in their order, by all pairs of lines."""
    lines = [(r, k, line) for r, (_, t) in enumerate(rows) for k, line in enumerate((t or "").split("\n"))]
    sets = [shingles(x[2]) for x in lines]
    gone = {(r, k) for i, (r, k, _) in enumerate(lines) if any(sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))}
    return [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone), sum(x == r for x, _ in gone)) for r, (d, t) in enumerate(rows)]


def test_line_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "A\nq q"), (None, "z z z\nA"), (None, None), (4, "b b\n" + sentence(1)), (4, "c\nq q\nd d"), (4, "c\nq q\nd d"), (5, "c"), (6, "")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _removed int, Removed int")
    out = line_dedup.dedup_lines(table)
    assert out.columns == ["doc_id", "text", "_removed", "Removed", "_lines", "_removed_"]
    key = F.struct(F.coalesce("doc_id", F.lit(line_dedup.NULL_ID)), F.coalesce(F.xxhash64("text"), F.lit(0)))
    order = {r.text: k for k, r in enumerate(table.dropDuplicates(["text"]).orderBy(key).collect())}
    distinct = sorted({(i, t) for i, t in rows}, key=lambda r: order[r[1]])
    kept = {(i, t): (new, n) for (i, t), (_, new, n) in zip(distinct, plain_line_dedup(distinct))}
    assert Counter((r.doc_id, r.text, r._removed_) for r in out.collect()) == Counter((i, *kept[i, t]) for i, t in rows)
    assert sum("q q" in (r.text or "") for r in out.collect()) in (1, 2)


def test_line_dedup_of_long_posting_lists(spark):
    """Many lines that share a passage: some are near copies of each other, most are not."""
    rng = np.random.default_rng(11)
    base = sentence(21, 40).split()
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.integers(0, 40, int(rng.integers(0, 4))):
            words[at] = f"n{rng.integers(0, 30)}"
        rows.append((k, " ".join(words) + ("\n" + " ".join(base[:12] + [f"t{k % 50}", f"u{rng.integers(0, 9)}"]) if k % 2 else "")))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text, r._removed) for r in out.collect()) == plain_line_dedup(rows)


def test_line_dedup_far_down_a_long_document(spark):
    filler = [""] * 60_000
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, near), (2, "\n".join([*filler, near + " more", "a line of its own here", near]))]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].text, out[1]._removed) == (near, 0)
    assert (out[2].text, out[2]._lines, out[2]._removed) == ("\n".join([*filler, "a line of its own here"]), 60_003, 2)


def test_sentencepiece_equals_the_model(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    for r in sentencepiece_codec.encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model").collect():
        ids = model.encode(texts()[r.doc_id - 1] or "")
        assert r.ids == ids and r.round_trip and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<i4").tobytes())
    assert sentencepiece_codec.encode_documents(empty, f"{TOKENIZERS}/piece_bpe_32k.model").count() == 0


def test_sentencepiece_of_odd_texts_and_decoding(spark):
    import sentencepiece

    file = f"{TOKENIZERS}/piece_bpe_32k.model"
    model, rng = sentencepiece.SentencePieceProcessor(model_file=file), np.random.default_rng(8)
    pool = ["the", "  ", " ", "   ", "\0", "\n", "\t", "▁", "é", "漢", "ing", "aa", ".", "𝔘", "1", " a", "ﬁ"]
    rows = ["".join(pool[k] for k in rng.integers(0, len(pool), int(n))) for n in rng.integers(1, 60, 400)] + [" " * 3000, "a" * 3000, "\0" * 200, "x  y\0 " * 2000]
    codec = sentencepiece_codec.Codec(file)
    found = codec.encode(rows)
    assert [x.tolist() for x in found] == [model.encode(t) for t in rows]
    assert [codec.decode(x) for x in found] == [model.decode(x.tolist()) for x in found]
    table = spark.createDataFrame([(None, "a b", 1), (None, None, 2), (3, "x" * 2_000_00 + " y", 3), (3, "a b", 3), (3, "a b", 3)], "doc_id long, text string, ids int")
    out = sentencepiece_codec.encode_documents(table, file).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in out) == sorted((i is None, len(model.encode(t or ""))) for i, t in ((None, "a b"), (None, None), (3, "x" * 200_000 + " y"), (3, "a b"), (3, "a b")))


def test_token_files_equal_the_tokenizer(spark, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    rows = [*texts(), "A. b.! c'd.e, F.. 1. x<|ENDOFTEXT|> y<|endoftext|>. Q.", "one.\n\ntwo, Three;"]
    out = {r.doc_id: r for r in token_files.token_files(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), f"{TOKENIZERS}/word_bpe_49k.json").collect()}
    start = 0
    for i, t in enumerate(rows):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(empty, f"{TOKENIZERS}/word_bpe_49k.json").count() == 0


def test_token_sequences_by_memory_map(spark):
    from tokenizers import Tokenizer

    from nodeloom.llm.common import scratch

    own = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    rows = [(i, sentence(i, 300), "clash") for i in range(40)] + [(None, "null id", "x"), (5, sentence(5, 300), "x")]
    folder = scratch(spark, "test-tokens")
    table = spark.createDataFrame(rows, "doc_id long, text string, start string")
    shards = token_files.write_shards(table, f"{TOKENIZERS}/word_bpe_49k.json", 2, folder, length=16).orderBy("shard").collect()
    stream = []
    for shard in shards:
        found = token_files.Sequences(f"{folder.removeprefix('file://')}/{shard.name}.arrow")
        assert shard.first == len(stream)
        for k in range(len(found)):
            ids, mask = found[k]
            assert len(ids) == 16 and (k == len(found) - 1 or all(mask.to_pylist()))
            stream += ids[np.array(mask.to_pylist())].tolist()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert stream == [x for _, t, _ in order for x in [*own.encode(t, add_special_tokens=False).ids, 2]]
    assert token_files.token_files(table, f"{TOKENIZERS}/word_bpe_49k.json").count() == 42


def test_another_tokenizer_encodes_whole_texts():
    from tokenizers import Tokenizer

    file = f"{TOKENIZERS}/byte_bpe_50k.json"
    own, rows = Tokenizer.from_file(file), [sentence(1), "A b  c\n d", "", None]
    words = token_files.WordEncoder(file)
    assert not words.by_words and token_files.WordEncoder(f"{TOKENIZERS}/word_bpe_49k.json").lowers
    assert [x.tolist() for x in words.encode(rows)] == [own.encode(t or "", add_special_tokens=False).ids for t in rows]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    from nodeloom.llm import wordhash

    monkeypatch.setattr(wordhash, "mix", lambda x: x % np.uint64(3))
    raw = b"one two three two one four xne one\n"
    starts, ends, first, inverse = wordhash.distinct_words(raw)
    words = [raw[a:b] for a, b in zip(starts, ends)]
    assert [words[first[k]] for k in inverse] == words and len({words[i] for i in first}) == len(first)


@pytest.mark.parametrize("neighbour", ["Plain Words.", "x<|endoftext|>"])
def test_token_ids_of_decomposed_capitals(neighbour):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    marks = [*map(chr, range(0x300, 0x370)), "\u0327\u0331", "\u0338", "\u200d", "é", "漢"]
    rows = [f"{a}{c}{m}{b}. Z" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks for a, b in (("", ""), ("x", "Abc\n"), ("Y", m + "É!"))]
    found = token_files.WordEncoder(f"{TOKENIZERS}/word_bpe_49k.json").encode([*rows, neighbour])
    assert [x.tolist() for x in found[:-1]] == [x.ids for x in own.encode_batch(rows, add_special_tokens=False)]


def test_toxicity_on_held_out_documents(spark, docs):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_documents(table.select("doc_id", "text"), labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").toPandas()
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    auc = (out.score.rank()[out.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert len(toxic) > 20 and auc > 0.94 and toxic.predicted.mean() > 0.75 and clean.predicted.mean() < 0.02
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and len(none) == len(texts())


def plain_kneser_ney(texts_by_class, order, d):
    """Log-likelihood ratios of n-grams (as strings) by dictionaries, from lists of texts of the two classes (ordinary, toxic)."""
    gap = "\n"

    def grams(text):
        before, out = gap * (order - 1), set()
        for word in re.findall(r"[^\W_]+", text.lower()):
            line = before + word + gap
            out |= {line[k : k + order] for k in range(len(line) - order + 1)}
            before = (gap * order + word + gap)[-(order - 1) :]
        return out

    counts = [Counter(g for t in texts for g in grams(t)) for texts in texts_by_class]
    seen = set(counts[0]) | set(counts[1])

    def shared(longer, k):
        """Probability of each n-gram of k letters, from the distinct ones of k + 1."""
        c = Counter(g[1:] for g in longer)
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        cut = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        lower = shared(set(c), k - 1) if k > 1 else {"": 1 / (len(c) + 1)}
        total, types = Counter(), Counter(g[:-1] for g in c)
        for g, v in c.items():
            total[g[:-1]] += v
        return {g: (max(v - cut, 0) + cut * types[g[:-1]] * lower[g[1:] if k > 1 else ""]) / total[g[:-1]] for g, v in c.items()}

    lower, logs = shared(seen, order - 1), []
    for c in counts:
        total, cut = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            cut[g[:-1]] += min(0.8 * v, d)
        share = lambda g: cut[g] / total[g] if total[g] else 1.0  # noqa: B023, E731
        logs.append({g: math.log((c[g] - min(0.8 * c[g], d)) / max(total[g[:-1]], 1) + share(g[:-1]) * lower[g[1:]]) for g in seen})
    return {g: logs[1][g] - logs[0][g] for g in seen}


def test_toxicity_models_against_dictionaries(spark):
    rows = [(i, f"{sentence(i, 30)} {'vile' if i % 2 else 'kind'} words ѡasp" + (" zxqvornak" if i == 41 else ""), i % 2) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = [(t, y) for (i, t, y) in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sum("zxqvornak" in t for t, _ in learned) == 1
    sample = toxicity.training_sample(table, table.select("doc_id", "toxic"))
    letters = toxicity._letters(sample)
    assert "".join(map(chr, letters.codes)) == "".join(sorted({c for t, _ in learned for c in t if c != " "}))
    keys, counts = toxicity._counts(sample, letters)
    number = {chr(c): k + 3 for k, c in enumerate(letters.codes.tolist())} | {"\n": toxicity.GAP}
    for d, found in zip((0.8, 2.0), toxicity.fit_ratios(letters, keys, counts[1].sum(0), counts[0].sum(0), (0.8, 2.0))):
        expected = plain_kneser_ney([[t for t, y in learned if y == k] for k in (0, 1)], letters.order, d)
        coded = {sum(number[c] << letters.bits * (letters.order - 1 - k) for k, c in enumerate(g)): v for g, v in expected.items()}
        assert found.keys.tolist() == sorted(coded)
        assert found.ratio == pytest.approx([coded[k] for k in found.keys.tolist()], abs=1e-5)


def test_toxicity_columns_of_the_same_names(spark, empty):
    rows = [(i, f"{sentence(i, 20)} {'vile' if i % 2 else 'kind'}", i % 2, -1.0) for i in range(60)] + [(None, None, None, None), (7, "", 1, 0.5), (7, "", 1, 0.5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double")
    out = toxicity.score_documents(table, table.select("doc_id", "toxic"))
    assert out.columns == ["doc_id", "text", "toxic", "score", "held_out", "score_", "predicted"]
    found = out.collect()
    assert len(found) == 63 and sorted((r.score is None, r.score or 0) for r in found) == sorted((r[3] is None, r[3] or 0) for r in rows)
    assert all(0 <= r.score_ <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert toxicity.score_documents(empty, table.select("doc_id", "toxic")).count() == 0


def test_toxicity_of_large_alphabets(spark):
    letters = toxicity.Letters(list(range(0x4E00, 0x9000)))
    assert letters.bits * letters.order <= 62 and letters.order >= 2 and len(set(letters.of(np.arange(0x4E00, 0x9000)).tolist())) == 0x9000 - 0x4E00


def test_secrets_against_plain_regexes(spark, empty):
    rows = [None, "", "password: hunter2hunter2", 'API_KEY = "abcDEF123456+/" passwd=short', "AKIA" + "A" * 14 + " " + "0123456789abcdef" * 2, "é𝔘 token=ABCDEFGHIJKL 0123456789abcde", "x" * 50_000 + " secret='abcdefabcdefabcdef'", "ghp_" + "Z" * 36]
    out = {r.doc_id: r for r in secret_scan.secret_digest(secret_scan.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(rows):
        spans = sorted((m.start(), k, m.end()) for k, r in enumerate(secret_scan.BASE) for m in re.finditer(r.pattern, t or "", r.flags) if len(m[r.group]) >= r.least)
        assert [out[i][f"n_{r.kind}"] for r in secret_scan.BASE] == [sum(k == j for _, j, _ in spans) for k in range(3)]
        assert out[i].base_sha256 == hashlib.sha256(",".join(f"{secret_scan.BASE[k].kind}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    assert out[7].spans == "github:0:40"
    assert secret_scan.find_secrets(empty).count() == 0


def test_secrets_of_repeated_rows_and_clashing_columns(spark):
    base = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    assert {r.kind: r.pattern for r in secret_scan.BASE} == base and [r.least for r in secret_scan.BASE] == [12, 18, 16]
    jwt = ".".join(["eyJ" + "a" * 12] * 2 + ["b" * 12])
    rows = [(None, f"x {jwt}", 1), (7, "token: abcdefghijkl", 2), (7, "token: abcdefghijkl", 2), (8, "eyJ" * 700_000, 3), (9, None, 4)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans int, found string")
    out = secret_scan.secret_digest(secret_scan.find_secrets(table)).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in out) == [(0, 0, f"jwt:2:{2 + len(jwt)}"), (7, 1, "assign:0:19"), (7, 1, "assign:0:19"), (8, 0, ""), (9, 0, "")]


@pytest.mark.parametrize("pattern", ["(abc|abd)[0-9]+xyz", "a?bcde{2}", "[ab]cd", "x*"])
def test_trigram_queries_are_implied(pattern):
    query = secret_scan.trigram_query(pattern)
    for t in ("abc1xyz", "bcdee", "acd", "bcd", "abd22xyz", "abcdee", ""):
        if re.search(pattern, t):
            assert query is True or any(all(g in t.encode() for g in way) for way in query)
