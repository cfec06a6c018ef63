"""File streams as a front end of the import: files that are new or have changed start one, the ledger decides what is pending.

The stream's offsets are logs of fingerprints (``sources.connector``), so a file that is rewritten arrives again. Spark's own file source knows files
by path alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from nodeloom.sources import connector
from nodeloom.sources.files import GLOB, parse_nodes


def changed_files(spark: SparkSession, folder: str, state: str, file_glob: str = GLOB) -> DataFrame:
    """A stream (source_file, fingerprint, value) of the files below a folder, each whenever its fingerprint is new. ``state`` is the stream's own folder."""
    connector.register(spark)
    return spark.readStream.format("nodeloom_files").option("state", state).option("fileGlob", file_glob).load(folder)


def changed_nodes(spark: SparkSession, folder: str, state: str, file_glob: str = GLOB) -> DataFrame:
    """A stream of the nodes of such files."""
    return parse_nodes(changed_files(spark, folder, state, file_glob).where("value is not null"))


def on_new_files(spark: SparkSession, folder: str, checkpoint: str, work: Callable[[], object], file_glob: str = GLOB) -> StreamingQuery:
    """Call ``work`` (an import of all pending files) for each batch of new or changed files, until none are left."""
    rows = changed_files(spark, folder, f"{checkpoint.rstrip('/')}/files", file_glob).select("source_file")
    return rows.writeStream.foreachBatch(lambda batch, _: work()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
