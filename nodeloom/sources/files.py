"""Files of processed documents: listing, fingerprints, and their nodes as rows."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.metadata import field, is_kind, speakers, text_of, truthy_text
from nodeloom.sources.shared import file_system, listed_by_few_tasks

#: All files of this name, however deep; the default of the configuration. Fixed value.
GLOB = "**/*.processed_documents.json"
PATTERN = GLOB.rsplit("/", 1)[1]


def reader_of(spark: SparkSession, folder: str, file_glob: str) -> tuple[DataFrameReader, str]:
    """A reader limited to the files of a glob, and the path to load: ``**`` stands for any depth, other parts for one level each.

    A folder part with wildcards must match something, as in any path that Spark reads.
    """
    *above, name = file_glob.split("/")
    deep = "**" in above
    parts = [part for part in above if part not in ("**", ".")]
    if not deep and any(c in part for part in parts for c in "*?[{"):
        parts.append(name)
    path = "/".join([folder.rstrip("/"), *parts])
    return spark.read.option("recursiveFileLookup", deep).option("pathGlobFilter", name), path


def list_files(spark: SparkSession, folder: str, file_glob: str = GLOB) -> DataFrame:
    """(source_file, fingerprint, path, plain_fingerprint) of the files below a folder; contents are not read.

    Names that start with a dot or an underscore are left out, as Spark's readers do. A fingerprint is path, size and
    modification time: a changed file has another one. ``source_file`` is a URI, ``path`` is not encoded; the plain fingerprint has a local path
    without its scheme, and milliseconds. Files of no bytes, which Spark lists but never reads, are told by their names.
    """
    reader, at = reader_of(spark, folder, file_glob)
    with listed_by_few_tasks(spark):
        rows = reader.format("binaryFile").load(at)
    uri = F.col("_metadata.file_path")
    found = rows.select(uri.alias("source_file"), "path", "length", F.unix_micros("modificationTime").alias("micros"))
    listed = rows.inputFiles()
    if len(listed) > rows.select("path").count():
        names = spark.createDataFrame([(re.sub("^file:/+", "file:/", name),) for name in listed], "source_file string")
        empty = [r[0] for r in names.join(found.select("source_file"), "source_file", "left_anti").collect()]
        found = found.union(spark.createDataFrame([_empty(spark, name) for name in empty], found.schema))
    plain = F.regexp_replace("path", "^file:/+", "/")
    own = F.concat_ws("|", "source_file", "length", "micros").alias("fingerprint")
    return found.select("source_file", own, "path", F.concat_ws("|", plain, "length", F.expr("micros div 1000")).alias("plain_fingerprint"))


def _empty(spark: SparkSession, uri: str) -> tuple:
    fs, path = file_system(spark, urllib.parse.unquote(uri))
    status = fs.getFileStatus(path)
    return uri, status.getPath().toString(), status.getLen(), status.getModificationTime() * 1000


def _parsed(files: DataFrame) -> DataFrame:
    """(source_file, title, documents, readable) of rows (source_file, value).

    A file that as a whole is no VARIANT (its size limit, a key twice) is read element by element, each its own VARIANT.
    """
    parts = F.from_json("value", "documents array<variant>, episode_title variant, _corrupt_record string")
    rows = files.select("source_file", "value", F.try_parse_json("value").alias("w"))
    rows = rows.select("source_file", "w", F.when(F.col("w").isNull(), parts).alias("p"))
    return rows.select(
        "source_file",
        text_of(F.coalesce(field(F.col("w"), "episode_title"), F.col("p.episode_title"))).alias("title"),
        F.coalesce(F.try_variant_get("w", "$.documents", "array<variant>"), F.col("p.documents")).alias("documents"),
        (F.col("w").isNotNull() | (F.col("p").isNotNull() & F.col("p._corrupt_record").isNull())).alias("readable"),
    )


def parse_files(files: DataFrame) -> DataFrame:
    """(source_file, readable, node) of rows (source_file, value): each file is parsed once, for its nodes and for whether it can be read.

    One row per object in ``documents``; a file without any has one row without a node, and so has a file whose JSON cannot be
    read. ``node`` has the columns of ``parse_nodes``.
    """
    rows = _parsed(files)
    objects = F.filter(F.transform("documents", lambda d, i: F.struct(i.alias("index"), d.alias("d"))), lambda x: is_kind(x["d"], "OBJECT"))
    rows = rows.select("source_file", "readable", "title", F.explode_outer(F.when(F.col("readable"), objects)).alias("x"))
    d = F.col("x.d")
    rows = rows.select("source_file", "readable", "title", F.col("x.index").alias("index"), d.alias("d"), field(d, "metadata").alias("m"))
    rows = rows.withColumn("m", F.when(is_kind(F.col("m"), "OBJECT"), F.col("m")).otherwise(F.parse_json(F.lit("{}"))))
    content = F.coalesce(text_of(field(F.col("d"), "page_content")), F.lit(""))
    label = F.concat_ws(" ", F.coalesce(text_of(field(F.col("m"), "node_type")), F.lit("unknown")), F.coalesce(text_of(field(F.col("m"), "node_id")), F.concat(F.lit("index_"), F.col("index"))))
    node = F.struct(
        F.col("index").alias("pos"),
        content.alias("page_content"),
        F.to_json("m").alias("metadata_json"),
        *(truthy_text(field(F.col("m"), k)).alias(k) for k in ("node_id", "node_type", "episode_date", "speaker_scope", "episode_title", "episode_id")),
        F.col("title").alias("file_title"),
        (F.to_json("m") != "{}").alias("has_metadata"),
        speakers(F.col("m")).alias("speakers"),
        label.alias("label"),
    )
    return rows.select("source_file", "readable", F.when(F.col("index").isNotNull(), node).alias("node"))


def nodes_of(parsed: DataFrame) -> DataFrame:
    """The nodes of ``parse_files``."""
    return parsed.where(F.col("node").isNotNull()).select("source_file", "node.*")


def unreadable_of(parsed: DataFrame) -> DataFrame:
    """(source_file) of the files whose JSON cannot be read."""
    return parsed.where("not readable").select("source_file")


def parse_nodes(files: DataFrame) -> DataFrame:
    """Nodes of rows (source_file, value), value being a file's JSON: one row per object in ``documents``.

    Elements that are no objects are dropped, but keep their numbers. Content and ids are texts whatever their
    JSON type: an absent content is empty, a null one the text None. Empty, zero or false ids, dates and
    scopes count as absent. ``label`` names a node in messages. A file that cannot be read gives no rows.
    """
    return nodes_of(parse_files(files))


def texts_of(spark: SparkSession, folder: str, file_glob: str) -> DataFrame:
    reader, at = reader_of(spark, folder, file_glob)
    with listed_by_few_tasks(spark):
        texts = reader.text(at, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("source_file"), "value")


def read_nodes(spark: SparkSession, folder: str, file_glob: str = GLOB) -> DataFrame:
    """Nodes of all files below a folder."""
    return parse_nodes(texts_of(spark, folder, file_glob))


def named_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, value) of the files at ``paths`` (as ``list_files`` names them): nothing is listed, no other file is opened.

    A file of no bytes has no row.
    """
    if not paths:
        return spark.createDataFrame([], "source_file string, value string")
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in paths]  # names, not patterns
    with listed_by_few_tasks(spark):
        texts = spark.read.text(plain, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("source_file"), "value")
