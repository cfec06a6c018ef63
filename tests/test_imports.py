import json
import os

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import episodes, manifest, order, quality, selection, store
from nodeloom.plans import imports
from nodeloom.sources import commits, files, manifest_json, settings
from nodeloom.streaming import incremental


def node(i, text="some text", **meta):
    return {"page_content": text, "metadata": {"node_id": f"n{i}", "node_type": "leaf_chunk", "episode_date": "2024-01-02", "speaker_scope": "single", "speaker": "Ann", **meta}}


def write(folder, name, *nodes, **rest):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.processed_documents.json", "w") as f:
        json.dump({"documents": list(nodes), **rest}, f, indent=2 if name in "abc" else None)


def run(spark, base, **options):
    return imports.import_pending(spark, f"{base}/in", f"{base}/ledger", f"{base}/store", store.hash_embedder(8), **options)


def test_parse_and_rollup(spark, tmp_path):
    write(f"{tmp_path}/in", "e1", node(1), "no object", {"metadata": {"node_id": 0}}, {"page_content": None}, episode_title="T")
    nodes = files.read_nodes(spark, f"{tmp_path}/in").orderBy("pos").collect()
    assert [(r.pos, r.page_content, r.node_id, r.label) for r in nodes] == [(0, "some text", "n1", "leaf_chunk n1"), (2, "", None, "unknown 0"), (3, "None", None, "unknown index_3")]
    row = episodes.rollup(files.read_nodes(spark, f"{tmp_path}/in")).first()
    assert (row.episode_id, row.episode_title, row.documents, row.insertable) == ("e1.processed_documents", "T", 3, 2)


def test_import_twice_then_change(spark, tmp_path):
    write(f"{tmp_path}/in", "a", node(1), node(2))
    write(f"{tmp_path}/in", "b", node(3))
    assert run(spark, tmp_path) == imports.Summary(2, 3, 3, 0)
    assert run(spark, tmp_path) == imports.Summary(0, 0, 0, 0)
    write(f"{tmp_path}/in", "a", node(1), node(2), node(4, "new text"))
    assert run(spark, tmp_path) == imports.Summary(1, 3, 1, 2)
    assert imports.stored_nodes(spark, f"{tmp_path}/store").count() == 4


def test_invalid_file_stops_behind_the_valid_ones(spark, tmp_path):
    write(f"{tmp_path}/in", "a", node(1))
    write(f"{tmp_path}/in", "b", node(2, " "), *[node(10 + i, "", episode_date="") for i in range(6)])
    write(f"{tmp_path}/in", "c", node(3))
    with pytest.raises(imports.InvalidFile, match="and 3 more"):
        run(spark, tmp_path)
    ledger = {r.path.rsplit("/", 1)[1][0]: r.status for r in imports.latest(imports.table(spark, f"{tmp_path}/ledger", imports.LEDGER)).collect()}
    assert ledger == {"a": "completed", "b": "failed"}
    write(f"{tmp_path}/in", "b", node(2))
    assert run(spark, tmp_path, one_file=True).files == 1
    assert run(spark, tmp_path).files == 1
    assert run(spark, tmp_path, stop=lambda: True).stopped


def test_export_generates_and_updates(spark, tmp_path):
    write(f"{tmp_path}/in", "a", node(1), node(2, speaker="Bob"))
    write(f"{tmp_path}/in", "b", node(3))
    paths = [r[0] for r in files.list_files(spark, f"{tmp_path}/in").orderBy("source_file").collect()]
    ann = spark.createDataFrame([(p, "Ann") for p in paths], "source_file string, speaker string")
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/out", "a/b")
    assert imports.export(*args, ann, store.hash_embedder(8), "generate") == imports.Summary(2, 2, 2, 0)
    assert imports.export(*args, ann, store.hash_embedder(8)) == imports.Summary(0, 0, 0, 0)
    both = ann.union(spark.createDataFrame([(paths[0], "Bob")], ann.schema))
    assert imports.export(*args, both, store.hash_embedder(8)) == imports.Summary(1, 2, 1, 1)
    document = json.load(open(commits.Commits(spark, f"{tmp_path}/out/a b").markers()[-1]["document"]))
    assert (document["episode_count"], document["chunk_count"], len(document["speakers"])) == (2, 3, 2)


@pytest.mark.parametrize("damaged", ['{"documents": [{"page_content": "cut', "no json"])
def test_unreadable_file_fails(spark, tmp_path, damaged):
    write(f"{tmp_path}/in", "a", node(1))
    with open(f"{tmp_path}/in/b.processed_documents.json", "w") as f:
        f.write(damaged)
    with pytest.raises(imports.InvalidFile, match="unreadable_json"):
        run(spark, tmp_path)
    ledger = {r.path.rsplit("/", 1)[1][0]: r.status for r in imports.latest(imports.table(spark, f"{tmp_path}/ledger", imports.LEDGER)).collect()}
    assert ledger == {"a": "completed", "b": "failed"}
    none = spark.createDataFrame([], "source_file string, speaker string")
    with pytest.raises(imports.InvalidFile, match="unreadable_json"):
        imports.export(spark, f"{tmp_path}/in", f"{tmp_path}/out", "x", none, store.hash_embedder(8))
    write(f"{tmp_path}/in", "b", node(2))
    assert run(spark, tmp_path) == imports.Summary(1, 1, 1, 0)


def test_file_that_is_no_variant_as_a_whole(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/a.processed_documents.json", "w") as f:
        f.write('{"x": 1, "x": 2, "episode_title": "T", "documents": [%s, "{}", null, 3, %s]}' % (json.dumps(node(1)), json.dumps(node(2))))
    assert [(r.pos, r.node_id, r.file_title) for r in files.read_nodes(spark, f"{tmp_path}/in").orderBy("pos").collect()] == [(0, "n1", "T"), (4, "n2", "T")]
    assert run(spark, tmp_path) == imports.Summary(1, 2, 2, 0)


def test_antijoin_below_embedding(spark):
    nodes = spark.createDataFrame([("a", "x")], "node_id string, page_content string")
    plan = store.embedded(store.pending_nodes(nodes, nodes.select("node_id")), store.hash_embedder(4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join LeftAnti")


def test_include_and_violations(spark):
    rows = [("f", i, f"n{i}", t, "2024", s, "text", sp, "l") for i, (t, s, sp) in enumerate([("episode_thesis", "x", ["A"]), ("cluster_summary", "single", ["A"]), ("cluster_summary", None, ["A"]), ("leaf_chunk", "x", []), (None, None, ["A"])])]
    nodes = spark.createDataFrame(rows, "source_file string, pos int, node_id string, node_type string, episode_date string, speaker_scope string, page_content string, speakers array<string>, label string")
    none = spark.createDataFrame([], "source_file string, speaker string")
    assert [r.pos for r in selection.included(nodes, none).orderBy("pos").collect()] == [0, 2, 3]
    assert [(r.pos, r.rule) for r in quality.violations(nodes).orderBy("pos").collect()] == [(2, "missing_speaker_scope")]
    assert quality.violations(nodes.limit(0)).count() == 0


def test_defaults_and_tristate(spark):
    sp = spark.createDataFrame([("f", "A"), ("f", "B"), ("g", "A"), ("h", "C")], "source_file string, speaker string")
    sel = spark.createDataFrame([("f", "A")], sp.schema)
    saved = spark.createDataFrame([("f",), ("g",)], "source_file string")
    assert sorted(map(tuple, selection.with_defaults(sp, sel, saved).collect())) == [("f", "A"), ("h", "C")]
    assert dict(map(tuple, selection.tristate(sp, sel).collect())) == {"A": "partial", "B": "unchecked", "C": "unchecked"}


def test_merge(spark):
    old = spark.createDataFrame([("f", "p", 3, "kept"), ("", "q", 9, "gone")], "source_file string, source_fingerprint string, document_count long, extra string")
    new = spark.createDataFrame([("f", "p2", 2), ("g", "r", 1)], "source_file string, source_fingerprint string, document_count long")
    assert sorted(map(tuple, manifest.merged(old, new).collect())) == [("f", "p2", 5, "kept"), ("g", "r", 1, None)]


def test_tolerant_names(spark):
    rows = spark.createDataFrame([('[{"name": " B "}, "A", 3, "", null]',)], "s string").select(manifest.tolerant_names(F.parse_json("s")))
    assert rows.first()[0] == ["B", "A", "3"]


def test_running_total_over_many_ranges(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"))
    out = order.running_total(rows, [F.col("k")], F.col("k"), "t").collect()
    assert all(r.t == r.k * (r.k + 1) // 2 for r in out) and len(out) == 3000
    assert order.running_total(rows.limit(0), [F.col("k")], F.col("k"), "t").count() == 0


def test_settings(spark, tmp_path):
    path = f"{tmp_path}/c.json"
    with open(path, "w") as f:
        json.dump({"import_batch_size": 5, "unknown": 1}, f)
    assert settings.load_config(path, persist_dir="p").import_batch_size == 5
    assert settings.load_config(None).skip_existing_ids
    with pytest.raises(ValueError):
        settings.ImportConfig(import_batch_size=0)
    chosen = spark.createDataFrame([("f", "B"), ("f", "A")], "source_file string, speaker string")
    listed = spark.createDataFrame([("f", "/f|1|2"), ("g", "/g|1|2")], "source_file string, plain_fingerprint string")
    manifest_json.write_settings(f"{tmp_path}/s.json", {"name": "x"}, chosen, listed)
    assert json.load(open(f"{tmp_path}/s.json")) == {"version": 1, "name": "x", "included_speakers_by_episode": {"/f|1|2": ["A", "B"], "/g|1|2": []}}
    header, sel, saved = manifest_json.read_settings(spark, f"{tmp_path}/s.json")
    assert header["name"] == "x" and sel.count() == 2 and saved.count() == 2
    with open(f"{tmp_path}/l.json", "w") as f:
        f.write("{")
    assert manifest_json.read_ledger(spark, f"{tmp_path}/l.json").count() == 0
    assert any(".corrupt." in x for x in os.listdir(tmp_path))


def test_stream_starts_imports(spark, tmp_path):
    write(f"{tmp_path}/in", "a", node(1))
    seen = []
    for _ in range(2):
        incremental.on_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/cp", lambda: seen.append(run(spark, tmp_path).inserted)).awaitTermination()
    assert seen == [1]


def test_jobs_of_few_files_progress_and_stop(spark, tmp_path):
    for name in "abcde":
        write(f"{tmp_path}/in/{name} %41{{x}}", name, node(name))
    seen = []
    first = run(spark, tmp_path, per_commit=2, progress=seen.append, stop=lambda: len(seen) == 1)
    assert first == imports.Summary(2, 2, 2, 0, True) and seen == [imports.Summary(2, 2, 2, 0)]
    write(f"{tmp_path}/in", "zz", node("zz", " "))
    with pytest.raises(imports.InvalidFile, match="zz"):
        run(spark, tmp_path, per_commit=2, progress=seen.append)
    assert [s.files for s in seen] == [2, 2, 3] and seen[-1].pending == 4 and imports.stored_nodes(spark, f"{tmp_path}/store").count() == 5
    statuses = imports.latest(imports.table(spark, f"{tmp_path}/ledger", imports.LEDGER)).groupBy("status").count().collect()
    assert dict(map(tuple, statuses)) == {"completed": 5, "failed": 1}


def test_only_the_named_files_are_read(spark, tmp_path):
    for k in range(6):
        write(f"{tmp_path}/in", f"f{k}", node(k))
    paths = [r.source_file for r in files.list_files(spark, f"{tmp_path}/in").orderBy("source_file").collect()]
    texts = files.named_texts(spark, paths[2:4])
    assert sorted(r.node_id for r in files.parse_nodes(texts).collect()) == ["n2", "n3"]
    assert len(texts.inputFiles()) == 2


@pytest.mark.parametrize("glob, expected", [("**/*.processed_documents.json", 3), ("*.processed_documents.json", 1), ("x/*.processed_documents.json", 1), ("*/*.processed_documents.json", 1), ("**/b*.json", 1)])
def test_file_glob(spark, tmp_path, glob, expected):
    write(f"{tmp_path}/in", "a", node(1))
    write(f"{tmp_path}/in/x", "b", node(2))
    write(f"{tmp_path}/in/x/y", "c", node(3))
    assert files.list_files(spark, f"{tmp_path}/in", glob).count() == expected
    assert run(spark, tmp_path, file_glob=glob).files == expected


def test_embedders_by_name(monkeypatch, spark):
    assert store.named_embedder("hash-16")(["a b"]).shape == (1, 16)
    with pytest.raises(ValueError, match="bge"):
        store.named_embedder("bge")
    sizes = spark.createDataFrame([(f"n{i}", "x") for i in range(10)], "node_id string, page_content string").coalesce(1)
    monkeypatch.setitem(store.EMBEDDERS, "count", lambda: lambda texts: [[float(len(texts))] for _ in texts])
    assert sorted(r.embedding[0] for r in store.embedded(sizes, store.named_embedder("count"), 4).collect()) == [2.0] * 2 + [4.0] * 8


def test_command_line(tmp_path, spark, capsys, monkeypatch):
    from nodeloom import cli

    write(f"{tmp_path}/processed_data/deep", "a", node(1), node(2))
    with open(f"{tmp_path}/c.json", "w") as f:
        json.dump({"embedding_model": "hash-8", "import_batch_size": 1, "file_glob": "**/a*.json"}, f)
    cli.main(["doctor", "--config", f"{tmp_path}/c.json"])
    cli.main(["import", "--config", f"{tmp_path}/c.json"])
    out = capsys.readouterr().out
    assert "PASS 1 files in" in out and "[1/1] documents=2" in out and "stopped=False files=1 documents=2 inserted=2 skipped=0" in out
    assert len(imports.stored_nodes(spark, f"{tmp_path}/store/nodes").first().embedding) == 8
    (tmp_path / "STOP").touch()
    cli.main(["--config", f"{tmp_path}/c.json"])
    assert "stopped=True" in capsys.readouterr().out


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(60):
        write(f"{tmp_path}/in/f{k:02}", "a", node(k))
    open(f"{tmp_path}/in/f07/none.processed_documents.json", "w").close()
    sc = spark.sparkContext
    sc.setJobGroup(str(tmp_path), "")
    listed = files.list_files(spark, f"{tmp_path}/in").orderBy("source_file").collect()
    assert files.read_nodes(spark, f"{tmp_path}/in").count() == 60
    assert files.named_texts(spark, [r.path for r in listed]).count() == 60  # one has no bytes
    assert len(listed) == 61
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup(str(tmp_path)) for s in told.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s and s.name.startswith(("load", "text"))) <= 2 * sc.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
