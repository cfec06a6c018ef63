"""Committed tables, waves, joined vectors, JSON documents, the connector and the stream of changed files."""

import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_imports import node, run, write

from nodeloom import cli
from nodeloom.functions.metadata import flat_json
from nodeloom.operators import order, store
from nodeloom.plans import imports
from nodeloom.sources import commits, connector, files, manifest_json, settings
from nodeloom.sources.settings import ExportPlan
from nodeloom.streaming import incremental


class Died(Exception):
    pass


def ids(spark, base):
    return sorted(r.node_id for r in imports.stored_nodes(spark, f"{base}/store").collect())


def ledger_of(spark, base):
    rows = imports.latest(commits.Commits(spark, f"{base}/store", ledger=f"{base}/ledger").read("ledger", imports.LEDGER))
    return {Path(r.path).name[0]: (r.status, r.documents, r.inserted, r.skipped_existing) for r in rows.collect()}


@pytest.mark.parametrize("at", [1, 2, 3, 4])
def test_a_run_that_dies_between_two_writes_is_made_good(spark, tmp_path, monkeypatch, at):
    write(f"{tmp_path}/in", "a", node(1), node(2))
    run(spark, tmp_path)
    write(f"{tmp_path}/in", "b", node(2), node(3), node(4, "other"))
    count = [0]

    def dying(f):
        def call(*args, **kwargs):
            count[0] += 1
            if count[0] == at:
                raise Died
            return f(*args, **kwargs)

        return call

    with monkeypatch.context() as m:
        for name in ("write", "publish"):
            m.setattr(commits.Commits, name, dying(getattr(commits.Commits, name)))
        with pytest.raises(Died):
            run(spark, tmp_path)
    assert ids(spark, tmp_path) == ["n1", "n2"] and ledger_of(spark, tmp_path) == {"a": ("completed", 2, 2, 0)}
    assert run(spark, tmp_path) == imports.Summary(1, 3, 2, 1)
    assert ids(spark, tmp_path) == ["n1", "n2", "n3", "n4"] and ledger_of(spark, tmp_path)["b"] == ("completed", 3, 2, 1)
    store_tables = commits.Commits(spark, f"{tmp_path}/store", ledger=f"{tmp_path}/ledger")
    assert store_tables.drop_unfinished(["rows", "vectors", "ledger"]) == at - 1
    assert ids(spark, tmp_path) == ["n1", "n2", "n3", "n4"]


def broken(path):
    """Make every Parquet file below a path unreadable."""
    for name in Path(path).rglob("*.parquet"):
        name.write_bytes(b"no parquet")
        name.with_name(f".{name.name}.crc").unlink(missing_ok=True)


def test_a_lookup_reads_the_parts_of_its_ids_only(spark, tmp_path):
    table = commits.Commits(spark, f"{tmp_path}/store")
    rows = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("f").alias("source_file"), F.col("id").cast("int").alias("pos"), F.lit("t").alias("page_content"), F.lit("{}").alias("metadata_json"), F.lit(b"x").alias("digest"))
    for k in range(2):
        number = table.new()
        table.write(rows.where(F.col("pos") % 2 == k), "rows", number, "node_id")
        table.publish(number, ["rows"])
    wanted = spark.createDataFrame([("n7",), ("n8",), ("other",), (None,), ("",)], "node_id string")
    mine = {r[0] for r in wanted.where("length(node_id) > 0").select(commits.part_of(F.col("node_id"))).collect()}
    for part in Path(f"{tmp_path}/store/rows").glob("commit=*/part=*"):
        if int(part.name.removeprefix("part=")) not in mine:
            broken(part)
    assert sorted(r.node_id for r in table.holding("rows", imports.ROWS, "node_id", wanted).collect()) == ["n7", "n8"]


def test_bloom_filter_in_front_of_a_large_lookup(spark, tmp_path):
    table = commits.Commits(spark, f"{tmp_path}/store")
    rows = spark.range(500).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("f").alias("source_file"), F.lit(0).alias("pos"), F.lit("t").alias("page_content"), F.lit("{}").alias("metadata_json"), F.lit(b"x").alias("digest"))
    number = table.new()
    table.write(rows, "rows", number, "node_id")
    table.publish(number, ["rows"])
    wanted = spark.range(3).select(F.concat(F.lit("n"), "id").alias("node_id"))
    wanted.write.parquet(f"{tmp_path}/wanted")
    settings = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = table.holding("rows", imports.ROWS, "node_id", spark.read.parquet(f"{tmp_path}/wanted"))
        assert "might_contain" in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == 3
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_the_jobs_of_a_wave_do_not_read_the_store(spark, tmp_path):
    write(f"{tmp_path}/in", "a", node(1), node(2))
    run(spark, tmp_path)
    for name in "bcd":
        write(f"{tmp_path}/in", name, node(1), node(name), node(f"{name}2", "some text"))
    pending = [(r.source_file, r.fingerprint, r.path) for r in files.list_files(spark, f"{tmp_path}/in").orderBy("source_file").collect()[1:]]
    table = commits.Commits(spark, f"{tmp_path}/store", ledger=f"{tmp_path}/ledger")
    wave = imports._Wave(table, pending, "", True, 1)
    for name in ("store/rows", "store/vectors", "ledger"):
        broken(f"{tmp_path}/{name}")
    done = [wave.run(job, store.hash_embedder(8), 64) for job in wave.jobs()]
    assert done == [imports.Summary(1, 3, 2, 1)] * 3


@pytest.mark.parametrize("per_commit, per_wave", [(1, 2), (100, 100)])
def test_ids_of_several_files(spark, tmp_path, per_commit, per_wave):
    write(f"{tmp_path}/in", "a", node(1, "first"), node(1, "second"))
    write(f"{tmp_path}/in", "b", node(1, "third"), node(2))
    write(f"{tmp_path}/in", "c", node(2, "fourth"), node(3))
    assert run(spark, tmp_path, per_commit=per_commit, per_wave=per_wave) == imports.Summary(3, 6, 4, 2)
    assert ledger_of(spark, tmp_path) == {"a": ("completed", 2, 2, 0), "b": ("completed", 2, 1, 1), "c": ("completed", 2, 1, 1)}
    texts = {r.node_id: r.page_content for r in imports.stored_nodes(spark, f"{tmp_path}/store").collect()}
    assert texts == {"n1": "second", "n2": "some text", "n3": "some text"}
    write(f"{tmp_path}/in", "a", node(1, "again"), node(3, "and again"))
    assert run(spark, tmp_path, per_commit=per_commit, skip_existing=False).inserted == 2
    texts = {r.node_id: r.page_content for r in imports.stored_nodes(spark, f"{tmp_path}/store").collect()}
    assert texts == {"n1": "again", "n2": "some text", "n3": "and again"}


def test_a_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def embed(texts):
        for t in texts:
            (log / f"{os.getpid()}-{np.random.default_rng().integers(1 << 60)}").write_text(t)
        return np.array([[float(len(t))] for t in texts], np.float32)

    def embedded():
        found = sorted(x.read_text() for x in log.iterdir())
        for x in log.iterdir():
            x.unlink()
        return found

    def again(**options):
        return imports.import_pending(spark, f"{tmp_path}/in", f"{tmp_path}/ledger", f"{tmp_path}/store", embed, per_commit=1, **options)

    write(f"{tmp_path}/in", "a", node(1, "x"), node(2, "yy"), node(3, "x"))
    write(f"{tmp_path}/in", "b", node(4, "x"), node(5, "zzz"))
    again(model="m")
    assert embedded() == ["x", "yy", "zzz"]
    write(f"{tmp_path}/in", "c", node(6, "x"), node(7, "zzz"))
    again(model="m")
    assert embedded() == []
    vectors = {r.node_id: r.embedding[0] for r in imports.stored_nodes(spark, f"{tmp_path}/store").collect()}
    assert vectors == {"n1": 1.0, "n2": 2.0, "n3": 1.0, "n4": 1.0, "n5": 3.0, "n6": 1.0, "n7": 3.0}
    write(f"{tmp_path}/in", "d", node(8, "x"))
    again(model="other")
    assert embedded() == ["x"]


def test_a_file_of_no_bytes_fails(spark, tmp_path):
    write(f"{tmp_path}/in", "a", node(1))
    Path(f"{tmp_path}/in/b.processed_documents.json").touch()
    with pytest.raises(imports.InvalidFile, match="unreadable_json"):
        run(spark, tmp_path)
    assert ledger_of(spark, tmp_path) == {"a": ("completed", 1, 1, 0), "b": ("failed", None, None, None)}


def test_fingerprints_are_those_of_the_file_system(spark, tmp_path):
    for name in ("a b", "c%41", "é[x]"):
        write(f"{tmp_path}/in/{name}", "f", node(1))
    (tmp_path / "in" / "empty.processed_documents.json").touch()
    found = {r.path.removeprefix("file:"): r for r in files.list_files(spark, f"{tmp_path}/in").collect()}
    listed = [str(p) for p in (tmp_path / "in").rglob("*.json")]
    assert sorted(found) == sorted(listed) and len(listed) == 4
    for p in listed:
        stat = os.stat(p)
        assert found[p].plain_fingerprint == f"{p}|{stat.st_size}|{stat.st_mtime_ns // 1_000_000}"
        assert found[p].source_file == connector.file_uri(p)
    for r in files.parse_files(files.named_texts(spark, list(found))).collect():
        assert r.readable and found[[p for p in found if found[p].source_file == r.source_file][0]]


def test_one_scan_gives_running_totals(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).withColumn("v", counted.asNondeterministic()("k"))
    out = order.running_total(rows, [F.col("k")], F.col("v"), "t")
    assert out.columns == ["k", "v", "t"] and all(r.t == r.k * (r.k + 1) // 2 for r in out.collect())
    assert seen.value == 1000
    ties = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k int, v int")
    assert sorted(map(tuple, order.running_total(ties, [F.col("k")], F.col("v"), "t").collect())) == [(1, 2, 5), (1, 3, 5), (2, 4, 9)]


def test_flat_json_equals_the_plain_version(spark):
    texts = ['{"a": [1,2,{"b":"é, \\"x: y\\" \\\\ 𝔘:", "c": null}], "t":"é:,", "n":5,"f":1.5,"z":null,"b":true, "o":{}, "l":[], "u\\u007f":"\\u007f"}', "{}", '{"long": ["%s"]}' % ("x,: é" * 20_000), '{"q": "\\"", "s": ["\\\\", "a\\"b", {"k": {"d": [[]]}}]}']

    def flat(text):
        return json.dumps({k: "" if v is None else v if isinstance(v, str | int | float | bool) else json.dumps(v) for k, v in sorted(json.loads(text).items())})

    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", flat_json(F.col("s")).alias("o")).collect()
    assert all(r.o == flat(r.s) for r in rows)
    odd = spark.createDataFrame([(None,), ("[1]",), ("no json",)], "s string").select(flat_json(F.col("s")).alias("o")).collect()
    assert [r.o for r in odd] == ["{}"] * 3


# --- JSON documents


def test_manifest_document(spark, tmp_path):
    rows = [(f"f{i}", f"p{i}", f"e{i}", f"Tïtle {i % 5} 𝔘", "" if i % 7 == 0 else f"2024-01-{1 + i % 28:02}", i) for i in range(60)]
    entries = spark.createDataFrame(rows, "source_file string, source_fingerprint string, episode_id string, episode_title string, episode_date string, document_count long").repartition(5)
    people = spark.createDataFrame([(f"f{i}", s) for i in range(60) for s in ("Zoë", f"Bob {i % 3}", '"q"')[: i % 4]], "source_file string, speaker string")
    path = f"{tmp_path}/deep/manifest.json"
    manifest_json.write_manifest(entries, people, {"podcast_name": "Nämé", "extra": "1"}, path)
    text = Path(path).read_text("ascii")
    found = json.loads(text)
    assert [e["source_file"] for e in found["episodes"]] == [r[0] for r in sorted(rows, key=lambda r: (r[4] or "9999-99-99", r[3], r[0]))]
    assert {e["source_file"]: (e["episode_title"], e["document_count"]) for e in found["episodes"]} == {r[0]: (r[3], r[5]) for r in rows}
    assert found["speakers"] == [{"id": "q", "name": '"q"'}, *({"id": f"bob-{k}", "name": f"Bob {k}"} for k in range(3)), {"id": "zoë", "name": "Zoë"}]
    assert (found["podcast_name"], found["extra"], found["episode_count"], found["chunk_count"]) == ("Nämé", "1", 60, sum(r[5] for r in rows))
    assert found["date_range"] == {"start": "2024-01-02", "end": "2024-01-28"}
    back, speakers = manifest_json.read_manifest(spark, path, strict=True)
    assert {r.source_file: r.document_count for r in back.collect()} == {r[0]: r[5] for r in rows}
    assert sorted((r.source_file, r.speaker) for r in speakers.collect()) == sorted(map(tuple, people.collect()))
    manifest_json.write_manifest(entries.limit(0), people.limit(0), {}, path)
    assert (json.loads(Path(path).read_text())["episodes"], json.loads(Path(path).read_text())["speakers"]) == ([], [])


def test_a_manifest_of_any_form_is_read(spark, tmp_path):
    path = f"{tmp_path}/m.json"
    document = {"episodes": [{"source_file": "f", "source_fingerprint": "p", "document_count": "3", "speakers": [{"name": " A "}, "B", 5, None, {}]}, {"source_file": "f", "document_count": "x"}, {"episode_date": None, "extra": {"y": 1}}]}
    Path(path).write_text(json.dumps(document, indent=2))
    entries, speakers = manifest_json.read_manifest(spark, path)
    assert [(r.ord, r.source_file, r.document_count) for r in entries.orderBy("ord").collect()] == [(0, "f", 3), (1, "f", None), (2, None, None)]
    assert sorted(r.speaker for r in speakers.collect()) == ["5", "A", "B"]
    from nodeloom.operators import manifest

    listed = spark.createDataFrame([("f", "q"), ("g", "p"), ("h", "z")], "source_file string, fingerprint string")
    badges = {r.source_file: r.badge for r in manifest.badges(listed, entries).collect()}
    assert badges == {"f": "[changed]", "g": "[imported]", "h": ""}
    for bad in ("{", "", "[1]", "no"):
        Path(path).write_text(bad)
        if bad:
            with pytest.raises(manifest_json.InvalidDocument):
                manifest_json.read_manifest(spark, path, strict=True)
        assert manifest_json.read_manifest(spark, path)[0].count() == 0
    assert manifest_json.read_manifest(spark, f"{tmp_path}/none.json", strict=True)[0].count() == 0


def test_a_ledger_document_keeps_files_from_being_imported_again(spark, tmp_path):
    for name in "abc":
        write(f"{tmp_path}/in", name, node(name))
    marks = {name: f"{tmp_path}/in/{name}.processed_documents.json" for name in "abc"}
    marks = {name: f"{p}|{os.stat(p).st_size}|{os.stat(p).st_mtime_ns}" for name, p in marks.items()}
    entry = lambda name, status: f'{json.dumps(marks[name])}: {{"path": "p", "status": "{status}", "inserted": 1}}'
    Path(f"{tmp_path}/l.json").write_text('{"version": 1, "files": {%s}}' % ", ".join([entry("a", "failed"), entry("b", "failed"), entry("a", "completed"), '"odd": {"status": "completed"}']))
    found = manifest_json.read_ledger(spark, f"{tmp_path}/l.json")
    assert {r.fingerprint: (r.status, r.inserted) for r in found.collect()} == {marks["a"]: ("completed", 1), marks["b"]: ("failed", 1), "odd": ("completed", None)}
    assert run(spark, tmp_path, ledger_json=f"{tmp_path}/l.json").files == 2
    assert ids(spark, tmp_path) == ["nb", "nc"]


# --- connector and stream


def store_rows(spark, n=50):
    return spark.createDataFrame([(f"n{i}", "f", i, "t", "{}", b"x") for i in range(n)], connector.TABLES["rows"]).repartition(3)


def test_connector_reads_what_imports_write_and_the_other_way_round(spark, tmp_path):
    connector.register(spark)
    write(f"{tmp_path}/in", "a", node(1), node(2))
    run(spark, tmp_path)
    read = lambda table: spark.read.format("nodeloom").option("table", table).load(f"{tmp_path}/store")
    assert sorted(r.node_id for r in read("rows").collect()) == ["n1", "n2"] and len(read("vectors").first().embedding) == 8
    store_rows(spark).write.format("nodeloom").mode("append").save(f"{tmp_path}/store")
    assert read("rows").count() == 52 and len(ids(spark, tmp_path)) == 50
    native = commits.Commits(spark, f"{tmp_path}/store").read("rows", imports.ROWS)
    assert native.where(F.col("part") != commits.part_of(F.col("node_id"))).count() == 0
    write(f"{tmp_path}/in", "b", node(3), node(99))
    assert run(spark, tmp_path) == imports.Summary(1, 2, 1, 1)
    store_rows(spark, 3).write.format("nodeloom").mode("overwrite").save(f"{tmp_path}/store")
    assert ids(spark, tmp_path) == ["n0", "n1", "n2"]
    with pytest.raises(Exception, match="columns of rows"):
        store_rows(spark).drop("pos").write.format("nodeloom").mode("append").save(f"{tmp_path}/store")
    with pytest.raises(Exception, match="no table"):
        read("other").count()


def test_an_aborted_write_is_not_seen(spark, tmp_path):
    connector.register(spark)
    store_rows(spark, 5).write.format("nodeloom").mode("append").save(f"{tmp_path}/store")

    @F.udf("string")
    def failing(x):
        if x == "n44":
            raise ValueError(x)
        return x

    with pytest.raises(Exception, match="n44"):
        store_rows(spark).withColumn("node_id", failing("node_id")).write.format("nodeloom").mode("append").save(f"{tmp_path}/store")
    assert spark.read.format("nodeloom").load(f"{tmp_path}/store").count() == 5
    assert commits.Commits(spark, f"{tmp_path}/store").drop_unfinished(["rows"]) <= 1  # of tasks that were still at work
    assert len(os.listdir(f"{tmp_path}/store/rows")) == 1


def test_files_of_a_task_that_ran_twice_do_not_count(tmp_path):
    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"source_file": "f", "speaker": "A", "speaker_id": "a"}])
    writer = connector.TableWriter(str(tmp_path), "speakers", False)
    writer.write(iter([rows]))
    kept = writer.write(iter([rows]))
    writer.commit([kept, None])
    assert [str(p) for p in tmp_path.rglob("*.parquet")] == kept.names
    reader = connector.TableReader(str(tmp_path), "speakers", None)
    assert [name for p in reader.partitions() for name, _ in p.names] == kept.names


def test_part_numbers_are_those_of_spark(spark):
    keys = ["", "a", "n123", "é𝔘", "x" * 100, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", commits.part_of(F.col("k")).alias("p")).collect()
    assert all(connector.part_number(r.k) == r.p for r in rows)
    rows = spark.createDataFrame([(bytes(range(n)),) for n in range(70)], "k binary").select("k", commits.part_of(F.col("k")).alias("p")).collect()
    assert all(connector.part_number(bytes(r.k)) == r.p for r in rows)


def test_a_rewritten_file_arrives_again(spark, tmp_path):
    write(f"{tmp_path}/in/x y", "a[1]", node(1))
    (tmp_path / "in" / "_hidden.processed_documents.json").write_text("{}")
    (tmp_path / "in" / "other.json").write_text("{}")
    seen = []

    def go():
        rows = incremental.changed_nodes(spark, f"{tmp_path}/in", f"{tmp_path}/cp/files").select("source_file", "node_id")
        rows.writeStream.foreachBatch(lambda b, _: seen.append(sorted(map(tuple, b.collect())))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    name = files.list_files(spark, f"{tmp_path}/in").first().source_file
    go()
    go()
    assert seen == [[(name, "n1")]]
    write(f"{tmp_path}/in/x y", "a[1]", node("rewritten"))
    write(f"{tmp_path}/in", "b", node(2))
    go()
    assert [x[1] for x in seen[1]] == ["n2", "nrewritten"] and len(seen) == 2
    reader = connector.ChangedFilesReader({"path": f"{tmp_path}/in", "state": f"{tmp_path}/cp/files", "fileglob": files.GLOB})
    assert reader.latestOffset() == {"log": 2}
    os.remove(f"{tmp_path}/in/b.processed_documents.json")
    parts = reader.partitions({"log": 1}, {"log": 2})
    assert sorted(t is None for p in parts for _, _, t in reader.read(p)) == [False, True]


def test_a_changed_file_starts_an_import(spark, tmp_path):
    write(f"{tmp_path}/in", "a", node(1))
    seen = []
    for k in range(2):
        incremental.on_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/cp", lambda: seen.append(run(spark, tmp_path).inserted)).awaitTermination()
        if not k:
            write(f"{tmp_path}/in", "a", node(1), node(2))
    assert seen == [1, 1]


# --- plans and the command line


def test_what_an_export_still_needs(spark):
    assert ExportPlan().missing(0) == ["choose a processed RAG output folder", "choose an output folder", "load at least one processed episode file", "enter a podcast name", "enter a collection", "enter an embedding model"]
    plan = ExportPlan(podcast_name=" My  Show! ", processed_data_dir="in", output_root="out").filled(spark)
    assert plan.missing(1) == [] and plan.missing(0) == ["load at least one processed episode file"]
    assert (plan.database_id, plan.collection_name, plan.embedding_model, plan.embedding_device) == ("my-show", "nodes", "hash-64", "auto")
    assert ExportPlan(processed_data_dir="/data/My Show/out/").named_after(spark).podcast_name == "My Show"
    assert ExportPlan(processed_data_dir="out").named_after(spark).podcast_name == "Podcast Export"
    assert [settings.device(d) for d in ("", " CUDA ", "cuda:1", "cpu")] == ["auto", "cuda:0", "cuda:1", "cpu"]
    assert ExportPlan.of({"database_id": "d", "other": "x"}) == ExportPlan(podcast_name="Podcast Chat Export", database_id="d")


def test_select_and_export_from_the_command_line(spark, tmp_path, capsys):
    write(f"{tmp_path}/in", "a", node(1), node(2, speaker="Bob"))
    write(f"{tmp_path}/in", "b", node(3))
    saved_at = f"{tmp_path}/s.json"
    cli.main(["select", "--settings", saved_at, "--processed-data-dir", f"{tmp_path}/in", "--output-root", f"{tmp_path}/out", "--podcast-name", "Show", "--embedding-model", "hash-8"])
    saved = json.loads(Path(saved_at).read_text())
    marks = sorted(saved["included_speakers_by_episode"])
    assert [saved["included_speakers_by_episode"][m] for m in marks] == [["Ann", "Bob"], ["Ann"]]
    # as another program would have saved it: times in nanoseconds, a file that nobody selects from, and no entry for the other
    stat = os.stat(f"{tmp_path}/in/a.processed_documents.json")
    saved["included_speakers_by_episode"] = {f"{tmp_path}/in/a.processed_documents.json|{stat.st_size}|{stat.st_mtime_ns}": ["Bob"]}
    Path(saved_at).write_text(json.dumps(saved))
    cli.main(["export", "--settings", saved_at, "--mode", "generate"])
    assert "episodes=2 selected=2 inserted=2" in capsys.readouterr().out
    document = json.loads(Path(commits.Commits(spark, f"{tmp_path}/out/Show").markers()[-1]["document"]).read_text())
    assert [(e["source_file"][-27:], [s["name"] for s in e["speakers"]]) for e in document["episodes"]] == [("/a.processed_documents.json", ["Bob"]), ("/b.processed_documents.json", ["Ann"])]
    assert (document["database_id"], document["embedding_model"], document["podcast_name"]) == ("show", "hash-8", "Show")
    with pytest.raises(SystemExit, match="choose an output folder"):
        cli.main(["export", "--processed-data-dir", f"{tmp_path}/in", "--podcast-name", "x"])


def test_doctor(spark, tmp_path, capsys):
    write(f"{tmp_path}/in", "a", node(1))
    (tmp_path / "in" / "b.processed_documents.json").write_text("{")
    args = ["doctor", "--config", f"{tmp_path}/c.json"]
    Path(f"{tmp_path}/c.json").write_text(json.dumps({"processed_data_dir": "in", "stop_file": "c.json"}))
    cli.main(args)
    out = capsys.readouterr().out
    assert "PASS embedder hash-64" in out and "PASS 2 files in" in out and "WARN 1 of them cannot be read" in out and "WARN c.json is there" in out
    Path(f"{tmp_path}/c.json").write_text(json.dumps({"processed_data_dir": "nowhere", "embedding_model": "x"}))
    with pytest.raises(SystemExit):
        cli.main(args)
    assert capsys.readouterr().out.count("FAIL") == 2


def test_a_crash_in_an_export_leaves_the_manifest_as_it_was(spark, tmp_path, monkeypatch):
    write(f"{tmp_path}/in", "a", node(1))
    paths = lambda: [r[0] for r in files.list_files(spark, f"{tmp_path}/in").orderBy("source_file").collect()]
    ann = lambda: spark.createDataFrame([(p, "Ann") for p in paths()], "source_file string, speaker string")
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/out", "x")
    imports.export(*args, ann(), store.hash_embedder(8), "generate")
    write(f"{tmp_path}/in", "b", node(2), node(1))
    with monkeypatch.context() as m:
        m.setattr(commits.Commits, "publish", lambda *a, **k: (_ for _ in ()).throw(Died()))
        with pytest.raises(Died):
            imports.export(*args, ann(), store.hash_embedder(8))
    table = commits.Commits(spark, f"{tmp_path}/out/x")
    assert table.read("entries", imports.ENTRIES, last_only=True).count() == 1 and imports.stored_nodes(spark, f"{tmp_path}/out/x").count() == 1
    assert imports.export(*args, ann(), store.hash_embedder(8)) == imports.Summary(1, 2, 1, 1)
    entries = {Path(r.source_file).name[0]: r.document_count for r in commits.Commits(spark, f"{tmp_path}/out/x").read("entries", imports.ENTRIES, last_only=True).collect()}
    assert entries == {"a": 1, "b": 1}
