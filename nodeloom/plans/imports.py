"""Imports with durable progress: which files are pending, what goes into the store, what the ledger says.

A store is a folder of tables that grow by commits (``sources.commits``): rows by hash of the node id, vectors by digest of the text, and with the
exports entries and speakers. The ledger may lie elsewhere, but counts by the same markers: a job's rows, vectors
and ledger appear together or not at all, so a run that dies is simply run again.

Files are taken in waves. A wave is parsed once and compared with the store once, by ids and by digests; its jobs, of
``per_commit`` files each, read only their own slices of that and never the store.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.metadata import flat_json
from nodeloom.functions.text import folder_name
from nodeloom.operators import episodes, manifest, quality, selection, store
from nodeloom.sources import files as source
from nodeloom.sources import manifest_json
from nodeloom.sources.commits import Commits
from nodeloom.sources.shared import Scratch

LEDGER = "fingerprint string, path string, status string, documents long, inserted long, skipped_existing long, error string, updated_at timestamp, commit long"
ROWS = "node_id string, source_file string, pos int, page_content string, metadata_json string, digest binary, commit long, part int"
VECTORS = "digest binary, embedding array<float>, commit long, part int"
ENTRIES = "source_file string, source_fingerprint string, episode_id string, episode_title string, episode_date string, document_count long, imported_at timestamp"
SPEAKERS = "source_file string, speaker string, speaker_id string"

#: Files of one job and commit, and files that are parsed and looked up at once (their names pass through the driver).
PER_COMMIT, PER_WAVE = 1000, 20_000


class InvalidFile(ValueError):
    """A file with violations: it is in the ledger as failed, files behind it were not touched."""


@dataclass
class Summary:
    """What was done so far; ``pending`` is the number of files that there were to do."""

    files: int
    documents: int
    inserted: int
    skipped_existing: int
    stopped: bool = False
    pending: int = field(default=0, compare=False)


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one while there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest(ledger: DataFrame) -> DataFrame:
    """The last row of each fingerprint."""
    rest = [c for c in ledger.columns if c != "fingerprint"]
    return ledger.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), "commit").alias("r")).select("fingerprint", "r.*")


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The store as it is now: the last row of each id, with the vector of its text."""
    commits = Commits(spark, path)
    rows = commits.read("rows", ROWS).drop("part")
    rest = [c for c in rows.columns if c != "node_id"]
    rows = rows.groupBy("node_id").agg(F.max_by(F.struct(*rest), F.struct("commit", "source_file", "pos")).alias("r")).select("node_id", "r.*")
    return store.with_vectors(rows, commits.read("vectors", VECTORS))


def _first_invalid(nodes: DataFrame, broken: DataFrame) -> tuple[DataFrame, str | None]:
    """(violations, first invalid file in path order) of nodes and of files that cannot be read."""
    bad = quality.violations(nodes).unionByName(quality.unreadable(broken))
    return bad, bad.agg(F.min("source_file")).first()[0]


def _message(bad: DataFrame, kind: str) -> str:
    text = quality.digest(bad, F.lit("all"), kind).first()
    return text["digest"] + (f" and {text['more']} more" if text["more"] else "")


class _Wave:
    """Files (source_file, fingerprint, path), parsed and looked up: what each job has to do, in tables by job."""

    def __init__(self, commits: Commits, names: list[tuple], model: str, skip_existing: bool, per_commit: int) -> None:
        spark, self.commits = commits.spark, commits
        self.tables = Scratch(spark, "import")
        self.files = spark.createDataFrame([(name, mark, k // per_commit) for k, (name, mark, _) in enumerate(names)], "source_file string, fingerprint string, job int")
        texts = source.named_texts(spark, [path for _, _, path in names])
        parsed = source.parse_files(texts).join(F.broadcast(self.files.select("source_file", "job")), "source_file")  # PER_WAVE rows at most
        digest = F.when(F.col("node").isNotNull(), store.text_digest(F.col("node.page_content"), model))
        self.parsed = self.tables.store(parsed.withColumn("digest", digest), "parsed", "job")
        readable = self.parsed.where("readable").select("source_file").distinct()
        self.bad, self.first = _first_invalid(source.nodes_of(self.parsed), self.files.join(readable, "source_file", "left_anti"))
        rows = self.rows().select("node_id", "source_file", "job", "pos", "digest")
        ids = rows.select("node_id", "source_file").distinct()
        if skip_existing:
            ids = store.fresh_ids(ids, commits.holding("rows", ROWS, "node_id", ids))
        self.fresh = self.tables.store(rows.join(ids, ["node_id", "source_file"], "left_semi"), "fresh", "job")
        # of rows with one id the last of a job is stored; a text is embedded in the first job that has it
        chosen = self.fresh.groupBy("job", "node_id").agg(F.max(F.struct("source_file", "pos", "digest")).alias("r"))
        self.chosen = self.tables.store(chosen.select("job", "node_id", "r.*"), "chosen", "job")
        todo = self.chosen.groupBy("digest").agg(F.min("job").alias("job"))
        self.todo = self.tables.store(todo.join(commits.holding("vectors", VECTORS, "digest", todo), "digest", "left_anti"), "todo", "job")

    def rows(self, job: int | None = None) -> DataFrame:
        """The nodes, of one job if it is given, in front of the first invalid file."""
        rows = self.parsed if job is None else self.parsed.where(F.col("job") == job)
        rows = rows if self.first is None else rows.where(F.col("source_file") < self.first)
        return rows.where(F.col("node").isNotNull()).select("source_file", "job", "digest", "node.*")

    def jobs(self) -> list[int]:
        good = self.files if self.first is None else self.files.where(F.col("source_file") < self.first)
        return list(range((good.agg(F.max("job")).first()[0] if not good.isEmpty() else -1) + 1))

    def _ledger(self, files: DataFrame, status: str, commit: int, error: str | None, counts: DataFrame | None = None) -> None:
        names = ("documents", "inserted", "skipped_existing")
        if counts is None:
            rows, sums = files, {c: F.lit(None).cast("long") for c in names}
        else:
            rows, sums = files.join(counts, "source_file", "left"), {c: F.coalesce(c, F.lit(0)).cast("long") for c in names}
        rows = rows.withColumns(sums)
        self.commits.write(rows.select("fingerprint", F.col("source_file").alias("path"), F.lit(status).alias("status"), *names, F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("updated_at")), "ledger", commit)

    def run(self, job: int, embedder: store.Embedder, batch_size: int) -> Summary:
        """Do one job and commit it."""
        commits, commit = self.commits, self.commits.new()
        rows, own = self.rows(job), F.col("job") == job
        files = self.files.where(own) if self.first is None else self.files.where(own & (F.col("source_file") < self.first))
        fresh = self.fresh.where(own).select("source_file", "pos", F.lit(True).alias("_fresh"))
        marked = rows.join(fresh, ["source_file", "pos"], "left")
        counts = marked.groupBy("source_file").agg(F.count("*").alias("documents"), F.count("_fresh").alias("inserted"), F.count_distinct(F.when(F.col("_fresh").isNull(), F.col("node_id"))).alias("skipped_existing"))
        self._ledger(files, "completed", commit, None, counts)
        taken = rows.join(self.chosen.where(own).select("source_file", "pos"), ["source_file", "pos"], "left_semi")
        _store(commits, commit, taken, rows.join(self.todo.where(own).select("digest"), "digest", "left_semi"), embedder, batch_size)
        commits.publish(commit, ["ledger", "rows", "vectors"])
        sums = commits.read("ledger", LEDGER, last_only=True).agg(F.count("*"), F.sum("documents"), F.sum("inserted"), F.sum("skipped_existing")).first()
        return Summary(*(x or 0 for x in sums))

    def fail(self) -> None:
        """Record the first invalid file and raise."""
        commit, own = self.commits.new(), F.col("source_file") == self.first
        message = _message(self.bad.where(own), "file")
        self._ledger(self.files.where(own), "failed", commit, message)
        self.commits.publish(commit, ["ledger"])
        raise InvalidFile(f"{self.first}: {message}")


def _store(commits: Commits, commit: int, taken: DataFrame, texts: DataFrame, embedder: store.Embedder, batch_size: int) -> None:
    """Write rows (one per id) and the vectors of the distinct ``texts``."""
    rows = taken.select("node_id", "source_file", "pos", "page_content", flat_json(F.col("metadata_json")).alias("metadata_json"), "digest")
    commits.write(rows, "rows", commit, "node_id")
    once = texts.groupBy("digest").agg(F.first("page_content").alias("page_content")).repartition(commits.spark.sparkContext.defaultParallelism)
    commits.write(store.embedded(once, embedder, batch_size).select("digest", "embedding"), "vectors", commit, "digest")


def _waves(pending: DataFrame, size: int) -> Iterator[list[tuple]]:
    names = (tuple(row) for row in pending.toLocalIterator())  # some partitions' names at a time
    while wave := list(itertools.islice(names, size)):
        yield wave


def import_pending(
    spark: SparkSession,
    folder: str,
    ledger_path: str,
    store_path: str,
    embedder: store.Embedder,
    one_file: bool = False,
    skip_existing: bool = True,
    stop: Callable[[], bool] = lambda: False,
    file_glob: str = source.GLOB,
    per_commit: int = PER_COMMIT,
    batch_size: int = 64,
    progress: Callable[[Summary], None] = lambda summary: None,
    model: str = "",
    ledger_json: str | None = None,
    per_wave: int = PER_WAVE,
) -> Summary:
    """Import all files whose fingerprint is not completed, in path order up to the first invalid one.

    ``per_commit`` files are one job; ``stop`` is asked before each, and ``progress`` gets the sums so far behind each. With 1 file a
    job that is asked and committed file by file. The invalid file is recorded as failed and
    raises InvalidFile after the files before it are committed; it is tried again by the next run. A file that is not JSON, or has no bytes, is
    invalid too. ``one_file`` takes the first pending file only. With ``skip_existing`` stored ids stay as they are, and an id that several
    files have is inserted by the first; else rows are replaced, the last file's stay. The embedder gets ``batch_size`` texts at once, and no text that
    the store has a vector for by the name ``model``. Files that a JSON ledger (``ledger_json``) names as completed are not pending either.
    """
    total = Summary(0, 0, 0, 0)
    if stop():
        return dataclasses.replace(total, stopped=True)
    commits = Commits(spark, store_path, ledger=ledger_path)
    pending = store.pending_files(source.list_files(spark, folder, file_glob), latest(commits.read("ledger", LEDGER)))
    if ledger_json is not None:
        pending = manifest_json.not_completed(pending, manifest_json.read_ledger(spark, ledger_json))
    listed = Scratch(spark, "pending")
    pending = listed.store(pending.select("source_file", "fingerprint", "path").orderBy("source_file"), "files")
    total.pending = min(1, pending.count()) if one_file else pending.count()
    pending = pending.orderBy("source_file")
    for names in _waves(pending.limit(1) if one_file else pending, per_wave):
        if total.files and stop():
            return dataclasses.replace(total, stopped=True)
        wave = _Wave(commits, names, model, skip_existing, per_commit)
        for job in wave.jobs():
            if total.files and stop():
                wave.tables.drop()
                return dataclasses.replace(total, stopped=True)
            part = wave.run(job, embedder, batch_size)
            total = Summary(total.files + part.files, total.documents + part.documents, total.inserted + part.inserted, total.skipped_existing + part.skipped_existing, pending=total.pending)
            progress(total)
        if wave.first is not None:
            wave.fail()
        wave.tables.drop()
    listed.drop()
    return total


def export(
    spark: SparkSession,
    folder: str,
    output_root: str,
    name: str,
    chosen: DataFrame,
    embedder: store.Embedder,
    mode: str = "update",
    file_glob: str = source.GLOB,
    batch_size: int = 64,
    about: dict[str, str] | None = None,
    model: str = "",
) -> Summary:
    """Export the selected nodes of all files with a manifest; ``generate`` starts afresh, ``update`` adds.

    Only selected nodes are validated; a file that is not JSON is an error, as its speakers are unknown. In update mode files whose effective speakers the manifest has are skipped,
    stored ids stay, and an id that several files have is inserted by the first; ``generate`` inserts every row, the last of an id stays. Rows, vectors
    and the manifest's tables are one commit. The manifest is also written as one JSON document, which the commit's marker names. ``about`` (database_id,
    collection_name, embedding_model, embedding_device, description) goes into its header.
    """
    if mode not in ("generate", "update"):
        raise ValueError("mode is generate or update")
    base = f"{output_root.rstrip('/')}/{spark.range(1).select(folder_name(F.lit(name))).first()[0]}"
    commits, tables = Commits(spark, base), Scratch(spark, "export")
    files = tables.store(source.list_files(spark, folder, file_glob).select("source_file", "fingerprint"), "files")
    parsed = tables.store(source.parse_files(source.texts_of(spark, folder, file_glob)), "parsed")
    nodes, readable = source.nodes_of(parsed), parsed.where("readable").select("source_file").distinct()
    update = mode == "update" and bool(commits.markers())
    old, old_speakers = (commits.read(t, s, last_only=True) if update else spark.createDataFrame([], s) for t, s in (("entries", ENTRIES), ("speakers", SPEAKERS)))
    old, old_speakers = old.drop("commit"), old_speakers.drop("commit")
    decision = manifest.skip_decision(files, old, old_speakers, selection.effective(episodes.episode_speakers(nodes), chosen))
    todo = tables.store(files.join(decision.where("not skip").select("source_file"), "source_file", "left_semi"), "todo")
    taken = selection.included(nodes.join(todo.select("source_file"), "source_file", "left_semi"), chosen)
    taken = tables.store(taken.withColumn("digest", store.text_digest(F.col("page_content"), model)), "taken")
    bad, first = _first_invalid(taken, files.join(readable, "source_file", "left_anti"))
    if first is not None:
        raise InvalidFile(_message(bad, "group"))
    fresh = taken
    if update:
        ids = taken.select("node_id", "source_file").distinct()
        fresh = taken.join(store.fresh_ids(ids, commits.holding("rows", ROWS, "node_id", ids)), ["node_id", "source_file"], "left_semi")
    fresh = tables.store(fresh, "fresh")
    rows = tables.store(store.last_by_id(fresh.select("node_id", "source_file", "pos", "page_content", "metadata_json", "digest")), "rows")
    held = commits.holding("vectors", VECTORS, "digest", rows) if update else rows.select("digest").limit(0)
    commit = commits.new()
    new = manifest.entries_of(fresh, episodes.rollup(nodes.join(todo.select("source_file"), "source_file", "left_semi")), todo).withColumn("imported_at", F.current_timestamp())
    commits.write(manifest.merged(old, new), "entries", commit)
    commits.write(manifest.merged_speakers(old_speakers, episodes.episode_speakers(taken)), "speakers", commit)
    _store(commits, commit, rows, rows.join(held, "digest", "left_anti"), embedder, batch_size)
    written = [spark.read.parquet(f"{commits.folder(t)}/commit={commit}") for t in ("entries", "speakers")]
    document = f"{base}/manifest-{commit}.json"
    manifest_json.write_manifest(*written, {"podcast_name": name, **(about or {})}, document)
    commits.publish(commit, ["entries", "speakers", "rows", "vectors"], fresh=not update, document=document)
    summary = (todo.count(), taken.count(), fresh.count())
    tables.drop()
    return Summary(*summary, summary[1] - summary[2])
