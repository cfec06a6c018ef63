"""Words made so that polynomial hashes agree, and a labelled text that would fill the sample of the toxicity models."""

import time
import zlib
from types import SimpleNamespace
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from nodeloom.llm import common, line_dedup, ngram_join, sentencepiece_codec, toxicity, wordhash
from nodeloom.llm.queries import TOKENIZERS


def agreeing_words(n, a="a", b="b"):
    """The Thue-Morse word of n letters and its complement: equal modulo 2**64 under every odd base, for n large enough."""
    word = "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans({a: b, b: a}))


def test_words_of_every_length_have_hashes_of_their_own():
    for n in (8, 16, 32, 64, 128, 512, 1024, 4096):
        words = [w for pair in ("ab", "ac", "xz") for w in agreeing_words(n, *pair)]
        hashes, starts, ends = wordhash.scan((" ".join(words) + "\n").encode())
        assert len(set(hashes.tolist())) == len(words)
        again, _, _ = wordhash.scan((" x ".join(words) + "\n").encode())
        assert set(hashes.tolist()) < set(again.tolist())  # wherever a word stands


def test_near_duplicates_and_lines_tell_such_words_apart(spark):
    one, two = agreeing_words(1024)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{two}"), (4, f"x {one} y"), (5, f"x {two} y")], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    kept = {r.doc_id: (r.text, r._removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == {1: (one, 0), 2: (two, 0), 3: ("", 1), 4: (f"x {one} y", 0), 5: (f"x {two} y", 0)}


def test_the_driver_collects_garbage_between_scratch_tables(spark, monkeypatch):
    calls = []
    system = SimpleNamespace(gc=lambda: calls.append(1))
    session = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(System=system)))))
    monkeypatch.setattr(common, "COLLECT_EVERY", 60.0)
    monkeypatch.setattr(common, "_collected", began := time.monotonic())
    common.collect_garbage(session)
    common.stored(spark.range(3), "rows")
    assert not calls and common._collected == began  # not yet
    for k in (1, 2):
        monkeypatch.setattr(common, "_collected", began - 60)
        common.collect_garbage(session)
        common.collect_garbage(session)
        assert len(calls) == k
    monkeypatch.setattr(common, "_collected", began - 60)
    assert sorted(r.id for r in common.stored(spark.range(3), "rows").collect()) == [0, 1, 2]
    assert common._collected > began


def test_a_long_labelled_text_keeps_no_other_out(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 20)) + (" vile words" if i % 2 else " kind words"), i % 2) for i in range(200)]
    learned = [i for i, _, y in rows if y and zlib.crc32(str(i).encode()) % 3 != 1]
    # the toxic document with the least hash of its id comes first in the sample
    first = spark.createDataFrame([(i,) for i in learned], "id long").orderBy(F.xxhash64("id")).first().id
    rows = [(i, "long text " * 2_000_000 if i == first else t, y) for i, t, y in rows]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(table, table.select("doc_id", "toxic"))
    assert model.left_out == 1
    out = {r.doc_id: r for r in toxicity.score_documents(table.where(F.col("doc_id") != first), table.select("doc_id", "toxic")).select("doc_id", "score", "predicted").collect()}
    right = [out[i].predicted == y for i, _, y in rows if i != first]
    assert sum(right) > 0.9 * len(right)


def test_the_sample_is_bounded_by_its_characters(spark):
    rows = [(i, "x" * 100, i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = toxicity.training_sample(table, table.select("doc_id", "toxic"), characters=6400).where("taken")
    assert {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()} == {0: 64, 1: 64}
    none = toxicity.training_sample(table, table.select("doc_id", "toxic"), characters=6399)  # 100 is more than a 64th
    assert none.where("taken").count() == 0 and none.where("text is not null").count() == 0


def test_repeated_tokens_equal_a_count(spark, monkeypatch):
    rng = np.random.default_rng(2)
    tokens = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    tokens = np.concatenate([tokens, tokens[:700], tokens[:5], tokens[:5], tokens[2990:] ^ (1 << 40)])  # some agree in the low bits only
    rng.shuffle(tokens)
    lists = [(tokens[lo : lo + 7].tolist(),) for lo in range(0, len(tokens), 7)] + [([],)]
    lines = spark.createDataFrame(lists, "prefix array<long>")
    low, n = np.unique(tokens & ((1 << 31) - 1), return_counts=True)
    for packed in (50, 1 << 22):
        monkeypatch.setattr(line_dedup, "PACKED", packed)
        found = [r.low for r in line_dedup.repeated_tokens(lines.repartition(3)).collect()]
        assert sorted(found) == low[n > 1].tolist()
    assert line_dedup.repeated_tokens(lines.limit(0)).count() == 0


def test_work_lets_go_of_what_other_work_has_kept():
    for _ in range(2):
        assert list(common.tidy(lambda rows: (common.kept("one model", list) for _ in rows), "one ")(iter([0]))) == [[]]
    assert "one model" in common._kept
    assert list(common.tidy(lambda rows: (len(common._kept) for _ in rows))(iter([0]))) == [0]


def test_line_dedup_holds_no_table_that_no_later_step_reads(spark, monkeypatch):
    held, store, drop = {}, common.Scratch.store, common.Scratch.drop
    there = set()

    def stored(self, df, name, *codec):
        held[name] = set(there)
        there.add(name)
        return store(self, df, name, *codec)

    def dropped(self, *names):
        there.difference_update(names or set(there))
        return drop(self, *names)

    monkeypatch.setattr(common.Scratch, "store", stored)
    monkeypatch.setattr(common.Scratch, "drop", dropped)
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, f"{line} {'x' * (k % 3)}\nown {k}") for k in range(30)]
    for table in (rows, rows + rows[:1]):  # without and with a repeated id
        held.clear()
        there.clear()
        assert line_dedup.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).agg({"_removed": "sum"}).first()[0] > 20
        assert "lines" in held["postings"] and not {"lines", "members", "repeated-tokens"} & held["lists"]
        assert not {"postings", "once", "lines"} & held["star"] and "star" not in held["removed"]


def test_line_dedup_names_lines_by_one_number_and_builds_no_dictionaries(spark, monkeypatch):
    kinds, encodings, store = {}, set(), common.Scratch.store

    def stored(self, df, name, *codec):
        out = store(self, df, name, *codec)
        if self.folder.rsplit("/", 1)[-1].startswith("line-dedup"):
            kinds.setdefault(name, dict(df.dtypes).get("x"))
            for file in out.inputFiles():
                meta = pq.ParquetFile(unquote(urlparse(file).path)).metadata
                encodings.update(e for g in range(meta.num_row_groups) for c in range(meta.num_columns) for e in meta.row_group(g).column(c).encodings)
        return out

    monkeypatch.setattr(common.Scratch, "store", stored)
    line = "one two three four five six seven eight nine ten eleven twelve"
    own = lambda k: f"{line} {'x' * (k % 3)}\nown {k}\n\n{line} and more {k}"
    found = []
    for ids in (range(-20, 20), [k << 58 for k in range(-20, 20)], [None, *range(1, 40)]):
        kinds.clear()
        table = spark.createDataFrame([(i, own(k)) for k, i in enumerate(ids)], "doc_id long, text string")
        rows = sorted(line_dedup.dedup_lines(table).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        found.append(([(r.text, r._removed) for r in rows], kinds["lines"], kinds["postings"], kinds["line-sets"]))
    assert found[0][0] == found[1][0] == found[2][0] and sum(n for _, n in found[0][0]) > 30
    assert found[0][1:] == ("bigint",) * 3 and found[1][1] == found[2][1] != "bigint"  # ids that leave no room for a line's number
    assert encodings and not any("DICTIONARY" in e for e in encodings)


def test_names_of_lines_are_in_their_order(spark):
    ids = [-(1 << 60), -1, 0, 1, (1 << 60) - 1]
    rows = spark.createDataFrame([(i, 0, n) for i in ids for n in (0, 1, 7)], "id long, h long, line int")
    naming = line_dedup.Naming.fitting(min(ids), max(ids), 7, False)
    out = rows.select(naming.name().alias("x")).orderBy("x").select(*naming.parts())
    assert naming.type == "long" and [tuple(r) for r in out.collect()] == [(i, 0, n) for i in ids for n in (0, 1, 7)]
    for low, high, most, repeated in ((-(1 << 60) - 1, 0, 7, False), (0, 1 << 60, 7, False), (0, 0, 1 << 31, False), (0, 0, 7, True)):
        assert line_dedup.Naming.fitting(low, high, most, repeated).type == line_dedup.X


def test_line_sets_move_once_for_both_sides_of_the_pairs(spark, tmp_path):
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for key, value in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(key, value)
        x = lambda k: (k, 0, 0)
        spark.createDataFrame([(x(1), [1, 2, 3, 4, 5]), (x(2), [1, 2, 3, 4, 5]), (x(3), [1, 9])], f"x {line_dedup.X}, tokens array<long>").write.parquet(str(tmp_path / "sets"))
        sets = spark.read.parquet(str(tmp_path / "sets"))
        pairs = spark.createDataFrame([(x(2), x(1)), (x(3), x(1))], f"x {line_dedup.X}, y {line_dedup.X}")
        out = line_dedup._matched(pairs, sets, 80, 100)
        assert [r.x.id for r in out.collect()] == [2]
        assert out._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_pieces_are_searched_by_blocks_of_characters(monkeypatch):
    codec = sentencepiece_codec.Codec(f"{TOKENIZERS}/piece_bpe_32k.model")
    longest = sorted(codec.ids, key=len)[-40:]
    units = [*longest, "a", "▁", "▁the", "𝔘\U0010ffff", "\0", "▁" * 40, *(p[:-1] for p in longest), *(p[1:] + "x" for p in longest)]
    codes = np.array([c for u in units for c in (*(ord(x) + 1 for x in u), 0)], np.int64)
    calls, where = [], np.where
    monkeypatch.setattr(np, "where", lambda *a: calls.append(1) or where(*a))
    found = set(zip(*(x.tolist() for x in codec.edges(codes)), strict=True))
    monkeypatch.undo()
    plain, at = set(), 0
    for u in units:
        for i in range(len(u)):
            plain |= {(at + i, at + j, codec.ids[u[i:j]]) for j in range(i + 1, len(u) + 1) if u[i:j] in codec.ids}
            plain |= set() if u[i] in codec.ids else {(at + i, at + i + 1, -ord(u[i]) - 2)}
        at += len(u) + 1
    assert found == plain
    # two calls a step of the searches: those are for blocks behind the first, each over what the blocks before it leave
    steps = int(np.log2(len(codes))) + 2
    assert len(calls) <= 4 * steps * (-(-codec.depth // sentencepiece_codec.BLOCK) - 1)


def test_a_codec_holds_no_units_behind_its_task(spark, monkeypatch):
    seen, file = [], f"{TOKENIZERS}/piece_bpe_32k.model"
    monkeypatch.setattr(sentencepiece_codec, "tidy", lambda work, keeps: seen.append(work) or common.tidy(work, keeps))
    docs = spark.createDataFrame([(k, f"word{k} and some others {k}") for k in range(50)], "doc_id long, text string")
    sentencepiece_codec.encode_documents(docs, file)
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array([f"word{k} and some others {k}" for k in range(50)])], ["doc_id", "text"])
    try:
        codec = sentencepiece_codec.codec(file)
        assert all(all(b.column("round_trip").to_pylist()) for b in seen[0](iter([batch])))
        assert not codec.known and not codec.before
        task = seen[0](iter([batch, batch]))
        next(task)
        assert codec.known
        task.close()  # a task that is ended early
        assert not codec.known and not codec.before
    finally:
        common.let_go(None)
