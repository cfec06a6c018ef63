"""Queries over whole imports and exports: conversations become files of valid nodes, are imported, exported, streamed and written through the connector.

Ten conversations are one file. Some ids are in several files and many texts in several nodes. The embedder counts characters and blanks, so that SQL has the same vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.metadata import quoted
from nodeloom.operators import episodes
from nodeloom.plans import imports
from nodeloom.plans.corpus import Corpus, with_tables
from nodeloom.sources import connector, manifest_json
from nodeloom.sources.commits import Commits
from nodeloom.sources.files import list_files, read_nodes
from nodeloom.sources.shared import file_system, scratch
from nodeloom.streaming.incremental import changed_nodes

GLOB = "**/part-*"
#: The nodes as they are written, for DuckDB: the id repeats over files for every fifth conversation's first turn, the text is one of few for every fourth node.
NODES = """v as (select conv_id // 10 as ep, row_number() over (partition by conv_id // 10 order by conv_id, turn) - 1 as pos, conv_id, turn,
  case when conv_id % 5 = 0 and turn = 0 then concat('shared-', conv_id % 35) else concat('c', conv_id, '-', turn) end as node_id,
  case when (conv_id + turn) % 4 = 0 then concat('text ', conv_id % 7) else concat('said: ', coalesce(text, '')) end as page_content,
  case when turn % 2 = 1 then 'leaf_chunk' else 'position_card' end as node_type, concat('2024-0', 1 + conv_id // 10 % 9, '-01') as episode_date, coalesce(nullif(role, ''), 'x') as speaker
  from conversations),
o as (select node_id, min(printf('%09d', ep)) as owner from v group by node_id),
f as (select v.*, printf('%09d', v.ep) = o.owner as fresh from v join o on v.node_id = o.node_id)"""


def counts(texts: list[str]) -> np.ndarray:
    """An embedder of two numbers: characters, and blanks."""
    return np.array([[len(t), t.count(" ")] for t in texts], np.float32).reshape(-1, 2)


_made: dict[tuple, str] = {}


def _once(c: Corpus, name: str, make: Callable[[str], None]) -> str:
    """A folder of this session and input that ``make`` fills when it is first asked for (or gone)."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir, name)
    if key in _made:
        fs, path = file_system(c.spark, _made[key])
        if fs.exists(path):
            return _made[key]
    folder = scratch(c.spark, name)
    make(folder)
    _made[key] = folder
    return folder


def written(c: Corpus) -> str:
    """The folder of the JSON files; their names have nine digits, so that their order is that of the numbers."""

    def make(folder: str) -> None:
        conv, turn, ep = F.col("conv_id"), F.col("turn"), F.floor(F.col("conv_id") / 10).cast("long")
        node_id = F.when((conv % 5 == 0) & (turn == 0), F.concat(F.lit("shared-"), conv % 35)).otherwise(F.concat(F.lit("c"), conv, F.lit("-"), turn))
        text = F.when((conv + turn) % 4 == 0, F.concat(F.lit("text "), conv % 7)).otherwise(F.concat(F.lit("said: "), F.coalesce("text", F.lit(""))))
        kind = F.when(turn % 2 == 1, F.lit("leaf_chunk")).otherwise(F.lit("position_card"))
        date = F.concat(F.lit("2024-0"), 1 + ep % 9, F.lit("-01"))
        fields = {"node_id": node_id, "node_type": kind, "episode_date": date, "speaker_scope": F.lit("single"), "speaker": F.coalesce(F.nullif("role", F.lit("")), F.lit("x"))}
        metadata = F.concat_ws(",\n  ", *(F.concat(F.lit(f'"{k}": '), quoted(v)) for k, v in fields.items()))
        json = F.concat(F.lit('{"page_content": '), quoted(text), F.lit(', "metadata": {'), metadata, F.lit("}}"))
        rows = c.table("conversations").select(F.lpad(ep.cast("string"), 9, "0").alias("ep"), F.struct("conv_id", "turn", json.alias("json")).alias("node"))
        files = rows.groupBy("ep").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x["json"]), ",\n").alias("nodes"))  # ten conversations
        title = F.concat(F.lit('"episode_title": "ep-'), "ep", F.lit('"'))  # else it is the name of the part file, which differs from run to run
        value = F.concat(F.lit("{\n"), title, F.lit(',\n"documents": ['), F.col("nodes"), F.lit("]\n}"))
        files.select(F.concat(F.lit("ep-"), "ep").alias("ep"), value.alias("value")).repartition("ep").write.partitionBy("ep").text(folder)

    return _once(c, "valid-documents", make)


def imported(c: Corpus) -> str:
    """A folder with the ledger and the store of two runs: one that stops behind its first job, and one to the end."""

    def make(folder: str) -> None:
        source = written(c)
        n = c.table("conversations").select(F.count_distinct(F.floor(F.col("conv_id") / 10))).first()[0]
        told: list[imports.Summary] = []
        options = {"file_glob": GLOB, "per_commit": max(1, n // 3), "progress": told.append, "model": "counts"}
        args = (c.spark, source, f"{folder}/ledger", f"{folder}/store", counts)
        imports.import_pending(*args, stop=lambda: bool(told), **options)
        imports.import_pending(*args, **options)

    return _once(c, "imported", make)


_REGISTRY: dict[str, tuple[Callable[[Corpus], DataFrame], str]] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL over the nodes as they were written."""

    def register(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        head = with_tables("").rstrip()
        _REGISTRY[f.__name__] = (f, f"{head},\n{NODES}\n{sql}")
        return f

    return register


def _ep(name: str = "source_file"):
    return F.regexp_extract(name, r"ep=ep-(\d+)", 1).cast("long").alias("ep")


@query("""select node_id, arg_max(ep, pos) as ep, max(pos) as pos, arg_max(page_content, pos) as page_content, cast(length(arg_max(page_content, pos)) as double) as characters,
  cast(length(arg_max(page_content, pos)) - length(replace(arg_max(page_content, pos), ' ', '')) as double) as blanks from f where fresh group by node_id""")
def import_store(c: Corpus) -> DataFrame:
    """The store behind both runs: each id from the first file that has it, with the vector of its text."""
    rows = imports.stored_nodes(c.spark, f"{imported(c)}/store")
    vector = [F.col("embedding")[k].cast("double").alias(name) for k, name in enumerate(("characters", "blanks"))]
    return rows.select("node_id", _ep(), F.col("pos").cast("long").alias("pos"), "page_content", *vector)


@query("select ep, 'completed' as status, count(*) as documents, count(*) filter (where fresh) as inserted, count(distinct case when not fresh then node_id end) as skipped_existing from f group by ep")
def import_ledger(c: Corpus) -> DataFrame:
    """What the ledger says of each file."""
    rows = imports.latest(Commits(c.spark, f"{imported(c)}/store", ledger=f"{imported(c)}/ledger").read("ledger", imports.LEDGER))
    return rows.select(_ep("path"), "status", "documents", "inserted", "skipped_existing")


@query("""select count(distinct page_content) as vectors, count(distinct page_content) as digests, sum(length(page_content))::bigint as characters
from (select distinct page_content from (select node_id, arg_max(page_content, pos) as page_content from f where fresh group by node_id))""")
def import_vectors(c: Corpus) -> DataFrame:
    """How many vectors the store has: one for each distinct text, whichever nodes and jobs have it."""
    rows = Commits(c.spark, f"{imported(c)}/store").read("vectors", imports.VECTORS)
    return rows.agg(F.count("*").alias("vectors"), F.count_distinct("digest").alias("digests"), F.sum(F.col("embedding")[0]).cast("long").alias("characters"))


def _chosen(c: Corpus) -> DataFrame:
    speakers = episodes.episode_speakers(read_nodes(c.spark, written(c), GLOB))
    return speakers.where((_ep() % 3 != 0) | (F.col("speaker") == "user"))


@query("""select g.ep, g.date as episode_date, coalesce(i.n, 0) as document_count, coalesce(i.speakers, '') as speakers,
  row_number() over (order by g.date, printf('ep-%09d', g.ep)) - 1 as place
from (select ep, min(episode_date) as date, count(*) filter (where ep % 3 <> 0 or speaker = 'user') as chosen from f group by ep) g
left join (select ep, count(*) filter (where printf('%09d', ep) = owner) as n, string_agg(distinct speaker, '|' order by speaker) as speakers
  from (select v.*, w.owner from v join (select node_id, min(printf('%09d', ep)) as owner from v where (ep % 3 <> 0 or speaker = 'user' or speaker in ('mixed', 'multiple', 'unknown')) group by node_id) w on v.node_id = w.node_id
    where (ep % 3 <> 0 or speaker = 'user' or speaker in ('mixed', 'multiple', 'unknown'))) group by ep) i on g.ep = i.ep""")
def export_manifest(c: Corpus) -> DataFrame:
    """The manifest document of an export, read back: a first one of nothing, then an update that adds the selected nodes."""

    def make(folder: str) -> None:
        args = (c.spark, written(c), folder, "An export")
        imports.export(*args, _chosen(c).limit(0), counts, "generate", GLOB)
        imports.export(*args, _chosen(c), counts, "update", GLOB)

    base = f"{_once(c, 'exported', make)}/An export"
    entries, speakers = manifest_json.read_manifest(c.spark, Commits(c.spark, base).markers()[-1]["document"], strict=True)
    names = speakers.groupBy("ord").agg(F.array_join(F.array_sort(F.collect_list("speaker")), "|").alias("speakers"))
    rows = entries.join(names, "ord", "left")
    return rows.select(_ep(), "episode_date", "document_count", F.coalesce("speakers", F.lit("")).alias("speakers"), F.col("ord").cast("long").alias("place"))


@query("select ep, pos, node_id, page_content, node_type, speaker from v")
def streamed_nodes(c: Corpus) -> DataFrame:
    """The nodes that a stream of new and changed files brings, run until nothing is left and once more."""

    def make(folder: str) -> None:
        for _ in range(2):
            nodes = changed_nodes(c.spark, written(c), f"{folder}/seen", GLOB).select("source_file", "pos", "node_id", "page_content", "node_type", "speakers")
            nodes.writeStream.format("parquet").option("path", f"{folder}/nodes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    rows = c.spark.read.parquet(f"{_once(c, 'streamed', make)}/nodes")
    speaker = F.coalesce(F.get("speakers", F.lit(0)), F.lit("multiple"))
    return rows.select(_ep(), F.col("pos").cast("long").alias("pos"), "node_id", "page_content", "node_type", speaker.alias("speaker"))


@query("select node_id, pos, page_content, cast(1 + (turn % 2) as bigint) as written_in from v where not (conv_id % 5 = 0 and turn = 0)")
def connector_rows(c: Corpus) -> DataFrame:
    """Rows of a store written by the connector in two commits and read back by it."""

    def make(folder: str) -> None:
        connector.register(c.spark)
        rows = read_nodes(c.spark, written(c), GLOB).where("node_id like 'c%'")
        rows = rows.select("node_id", "source_file", "pos", "page_content", "metadata_json", F.unhex(F.sha2("page_content", 256)).alias("digest"))
        for k in range(2):
            turn = F.regexp_extract("node_id", r"-(\d+)$", 1).cast("int")
            rows.where(turn % 2 == k).write.format("nodeloom").mode("append").save(folder)

    folder = _once(c, "connected", make)
    connector.register(c.spark)
    rows = c.spark.read.format("nodeloom").option("table", "rows").load(folder)
    first = rows.agg(F.min("commit").alias("first"))
    return rows.crossJoin(F.broadcast(first)).select("node_id", F.col("pos").cast("long").alias("pos"), "page_content", F.when(F.col("commit") == F.col("first"), 1).otherwise(2).cast("long").alias("written_in"))  # one row


@query("select ep, ep % 4 <> 1 as pending from (select distinct ep from v)")
def ledger_document(c: Corpus) -> DataFrame:
    """Files that are still pending when a JSON ledger names every fourth as completed, some of them twice, and others as failed."""

    def make(folder: str) -> None:
        files = list_files(c.spark, written(c), GLOB)
        nanos = F.concat(F.regexp_replace("plain_fingerprint", r"\d+$", ""), F.regexp_extract("plain_fingerprint", r"(\d+)$", 1), F.lit("123456"))
        status = F.when(_ep() % 4 == 1, "completed").otherwise("failed")
        entry = lambda s: F.concat(quoted(nanos), F.lit(': {"path": '), quoted(F.col("path")), F.lit(', "status": '), quoted(s), F.lit(', "documents": 3}'))
        lines = files.select(F.concat(entry(F.lit("failed")), F.lit(","), entry(status)).alias("value"), "source_file")  # the last of a key counts
        manifest_json.write_document(c.spark, f"{folder}/ledger.json", {"version": 1}, {"files": ("{}", lines, ["source_file"])})

    ledger = manifest_json.read_ledger(c.spark, f"{_once(c, 'ledger-document', make)}/ledger.json")
    files = list_files(c.spark, written(c), GLOB)
    pending = manifest_json.not_completed(files, ledger).select("source_file", F.lit(True).alias("pending"))
    return files.select("source_file").join(pending, "source_file", "left").select(_ep(), F.coalesce("pending", F.lit(False)).alias("pending"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir)) for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items()}
