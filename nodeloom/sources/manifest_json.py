"""The manifest and the ledger as JSON documents: read permissively into tables, and written in order without one task holding them."""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.metadata import ascii_only, quoted
from nodeloom.functions.text import slug
from nodeloom.operators.episodes import catalogue_order
from nodeloom.operators.manifest import header, tolerant_names
from nodeloom.operators.order import last_of_key
from nodeloom.sources.shared import Scratch, file_system

#: Keys of a manifest's episodes and of a ledger's files that are read as texts. Fixed values.
EPISODE = ("source_file", "source_fingerprint", "episode_id", "episode_title", "episode_date", "document_count", "imported_at")
FILE = ("path", "status", "documents", "inserted", "skipped_existing", "error", "updated_at")
#: Keys of a manifest's head that name what it was made with, in their order. Fixed values.
ABOUT = ("podcast_name", "database_id", "collection_name", "embedding_model", "embedding_device", "description")
MAKER = "nodeloom"
#: Key of a settings document's selections. Fixed value.
SELECTED = "included_speakers_by_episode"


class InvalidDocument(ValueError):
    """A JSON document that cannot be read."""


def _document(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    """One row ``r`` of the document's fields; none if there is no file, or (not strict) if it is no JSON object."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"r struct<{schema.replace(' ', ': ', 1)}, _corrupt_record: string>")
    rows = rows.select(F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    if strict and not rows.where(~F.coalesce(good, F.lit(False))).isEmpty():
        raise InvalidDocument(f"{path} is not a JSON object")
    return rows.where(good)


def read_manifest(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, speakers) of a manifest document.

    Entries have the columns of EPISODE as texts (document_count a long, null if it is no number) and ``ord``, their place in the document, by
    which the last of several with one key counts. Speakers are rows (ord, source_file, speaker), from names or objects with
    one. A missing file gives no rows; so does one that is no JSON object, unless ``strict``, which raises InvalidDocument.
    """
    fields = ", ".join(f"{c}: string" for c in EPISODE)
    rows = _document(spark, path, f"episodes array<struct<{fields}, speakers: variant>>", strict)
    rows = rows.select(F.posexplode("r.episodes").alias("ord", "e")).where(F.col("e").isNotNull())
    columns = [F.col(f"e.{c}") for c in EPISODE if c != "document_count"]
    entries = rows.select("ord", *columns, F.col("e.document_count").try_cast("long").alias("document_count"))
    names = F.explode(tolerant_names(F.col("e.speakers")))
    return entries, rows.select("ord", F.col("e.source_file").alias("source_file"), names.alias("speaker"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, the columns of FILE) of a ledger document; of a fingerprint that comes twice the last counts.

    One that cannot be parsed is copied aside, with the time in its name, and counts as empty.
    """
    fields = ", ".join(f"{c}: string" for c in FILE)
    try:
        rows = _document(spark, path, f"files map<string, struct<{fields}>>", True)
    except InvalidDocument:
        fs, source = file_system(spark, path)
        name = source.getName().removesuffix(".json")
        _, aside = file_system(spark, f"{source.getParent().toString()}/{name}.corrupt.{int(time.time())}.json")
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, aside, False, spark.sparkContext._jsc.hadoopConfiguration())
        rows = _document(spark, path, f"files map<string, struct<{fields}>>", False)
    entries = rows.select(F.posexplode(F.map_entries("r.files")).alias("ord", "e")).select("ord", F.col("e.key").alias("fingerprint"), *(F.col(f"e.value.{c}") for c in FILE))
    counts = {c: F.col(c).try_cast("long") for c in ("documents", "inserted", "skipped_existing")}
    return last_of_key(entries, "fingerprint", "ord").drop("ord").withColumns(counts)


def read_settings(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame, DataFrame]:
    """(header, selection, saved) of a settings document: its other members as texts, rows (key, speaker), and every key, also those that select nobody."""
    rows = _document(spark, path, f"{SELECTED} map<string, array<string>>", True)
    chosen = rows.select(F.posexplode(F.map_entries(f"r.{SELECTED}")).alias("ord", "e")).select("ord", F.col("e.key").alias("key"), F.col("e.value").alias("names"))
    chosen = last_of_key(chosen, "key", "ord")
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    head = text.select(F.map_filter("m", lambda k, v: k != SELECTED).alias("m")).first()
    return dict(head["m"] or {}) if head else {}, chosen.select("key", F.explode("names").alias("speaker")), chosen.select("key")


def write_settings(path: str, head: dict[str, str], selection: DataFrame, files: DataFrame) -> None:
    """Write version 1 of a settings document: each file of files (source_file, plain_fingerprint) has its sorted list of speakers, empty ones too."""
    rows = files.select("source_file", "plain_fingerprint").join(selection.groupBy("source_file").agg(F.array_sort(F.collect_set("speaker")).alias("s")), "source_file", "left")
    names = F.array_join(F.transform(F.coalesce("s", F.array().cast("array<string>")), quoted), ", ")
    lines = rows.select(F.concat(quoted(F.col("plain_fingerprint")), F.lit(": ["), names, F.lit("]")).alias("value"), "source_file")
    write_document(files.sparkSession, path, {"version": 1, **head}, {SELECTED: ("{}", lines, ["source_file"])})


def in_millis(mark: Column) -> Column:
    """A plain fingerprint whose time is in nanoseconds (19 digits) as one in milliseconds; others stay."""
    return F.regexp_replace(mark, r"\|(\d{13})\d{6}$", r"|$1")


def by_file(files: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(key) with the ``source_file`` that the key means: a plain fingerprint, or a source_file itself."""
    names = files.select("source_file", F.col("plain_fingerprint").alias("_mark")).union(files.select("source_file", "source_file"))
    return rows.withColumn("_mark", in_millis(F.col("key"))).join(names, "_mark").select("source_file", *rows.columns).distinct()


def not_completed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files(plain_fingerprint) that a ledger document does not name as completed."""
    done = ledger.where("status = 'completed'").select(in_millis(F.col("fingerprint")).alias("plain_fingerprint"))
    return files.join(done, "plain_fingerprint", "left_anti")


def _json(**members: Column) -> Column:
    """An object of columns that hold JSON text."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in members.items())), F.lit("}"))


def _text(name: str) -> Column:
    return quoted(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _speaker(name: Column) -> Column:
    return _json(id=quoted(slug(name)), name=quoted(name))


def write_manifest(entries: DataFrame, speakers: DataFrame, about: dict[str, str], path: str) -> None:
    """Write entries and their speakers (source_file, speaker) as one JSON document in ASCII, by date (none last), title and path.

    Tasks write the episodes of one range of that order each, one a line; then the files are copied behind each other, byte by byte.
    No task and no list holds all of them.
    """
    spark = entries.sparkSession
    tables = Scratch(spark, "manifest")
    lists = speakers.groupBy("source_file").agg(F.array_sort(F.collect_set("speaker")).alias("_names"))
    rows = entries.join(lists, "source_file", "left")
    names = F.array_join(F.transform(F.coalesce("_names", F.array().cast("array<string>")), _speaker), ", ")
    members = {c: _text(c) for c in EPISODE if c in entries.columns}
    members["document_count"] = F.coalesce(F.col("document_count").cast("string"), F.lit("0"))
    line = _json(**members, speakers=F.concat(F.lit("["), names, F.lit("]")))
    keys = [k.alias(f"_k{i}") for i, k in enumerate(catalogue_order())]
    sort = [f"_k{i}" for i in range(len(keys))]
    rows = tables.store(rows.select(line.alias("value"), *keys), "episodes")  # once for the ranges' bounds and the lines
    head = header(entries, speakers).first().asDict()
    top = {k: (about or {}).get(k, "") for k in (*ABOUT, *(k for k in about if k not in ABOUT))}
    top |= {"date_range": {"start": head["start_date"], "end": head["end_date"]}, "episode_count": head["episode_count"], "chunk_count": head["chunk_count"], "generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "generated_by": MAKER}
    every = speakers.select("speaker").distinct().select(_speaker(F.col("speaker")).alias("value"), "speaker")
    write_document(spark, path, top, {"speakers": ("[]", every, ["speaker"]), "episodes": ("[]", rows, sort)})
    tables.drop()


def write_document(spark: SparkSession, path: str, head: dict, sections: dict[str, tuple[str, DataFrame, list[str]]]) -> None:
    """Write a JSON object of the members of ``head`` and of sections: brackets, rows (value: JSON text of an item or member, and keys), and the keys' names by which they are ordered.

    The document is put in place by a rename.
    """
    tables = Scratch(spark, "document")
    for key, (_, rows, sort) in sections.items():
        _lines(rows, sort, f"{tables.folder}/{key}")
    fs, target = file_system(spark, path)
    _, hidden = file_system(spark, f"{target.getParent().toString()}/_{target.getName()}.tmp")
    fs.setWriteChecksum(False)  # no checksum beside a file that other programs may edit
    out = fs.create(hidden, True)
    fs.setWriteChecksum(True)
    out.write(bytearray(json.dumps(head, indent=2)[:-2].encode()))
    for key, (brackets, _, _) in sections.items():
        out.write(bytearray(f',\n  "{key}": {brackets[0]}'.encode()))
        _append(spark, out, f"{tables.folder}/{key}")
        out.write(bytearray(brackets[1].encode()))
    out.write(bytearray(b"\n}\n"))
    out.close()
    fs.delete(target, False)
    if not fs.rename(hidden, target):
        raise OSError(f"{path} could not be put in place")
    tables.drop()


def _lines(rows: DataFrame, sort: list[str], folder: str) -> None:
    """Ordered files of lines, each with a comma in front."""
    ranges = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranges.select(F.concat(F.lit(","), ascii_only(F.col("value"))).alias("value")).write.text(folder)


def _append(spark: SparkSession, out, folder: str) -> None:
    """Copy the files of a folder in order, without the first comma."""
    fs, path = file_system(spark, folder)
    first = True
    for status in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
        if status.getPath().getName().startswith("part-") and status.getLen():
            source = fs.open(status.getPath())
            if first:
                source.seek(1)
            first = False
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
