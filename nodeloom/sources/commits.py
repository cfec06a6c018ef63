"""Tables that grow by commits: what a commit has written, in any of its tables, counts from its marker file on, all at once.

A table is a folder of Parquet folders ``commit=N``, and in tables that are looked up by an id, ``part=K`` below, K being a hash of
the id. The marker ``commits/N.json`` is put in place by a rename when all tables are written; readers load the folders
that markers name and never see those of a commit that died before. One writer at a time.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nodeloom.sources.shared import delete, file_system, listed_by_few_tasks

#: Parts that ids are dealt to. Fixed for a store: its folders are named by it.
PARTS = 64


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


class Commits:
    """The tables below ``root`` (or, by ``elsewhere``, in other folders) and their markers."""

    def __init__(self, spark: SparkSession, root: str, **elsewhere: str) -> None:
        self.spark, self.root, self.elsewhere = spark, root.rstrip("/"), elsewhere
        self._found: list[dict] | None = None

    def folder(self, table: str) -> str:
        return self.elsewhere.get(table, f"{self.root}/{table}").rstrip("/")

    def markers(self) -> list[dict]:
        """The commits that count, in order: those from the last one on that started afresh. They are listed once."""
        if self._found is not None:
            return self._found
        fs, folder = file_system(self.spark, f"{self.root}/commits")
        found = []
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            if name.endswith(".json"):
                found.append(json.loads(bytes(_content(self.spark, fs, status.getPath())).decode()))
        found.sort(key=lambda m: m["commit"])
        fresh = max((k for k, m in enumerate(found) if m["fresh"]), default=0)
        self._found = found[fresh:]
        return self._found

    def new(self) -> int:
        """The number of a new commit, above those of all before."""
        return max(time.time_ns(), max((m["commit"] for m in self.markers()), default=0) + 1)

    def write(self, rows: DataFrame, table: str, commit: int, key: str | None = None) -> None:
        """Write a table's rows of a commit; with a key they are dealt to parts, a part to one task."""
        path = f"{self.folder(table)}/commit={commit}"
        if key is None:
            rows.write.parquet(path)
        else:
            rows.withColumn("part", part_of(F.col(key))).repartition("part").write.partitionBy("part").parquet(path)

    def publish(self, commit: int, tables: list[str], fresh: bool = False, **about) -> None:
        """Let the commit count. ``fresh``: those before it no longer do."""
        fs, marker = file_system(self.spark, f"{self.root}/commits/{commit}.json")
        _, hidden = file_system(self.spark, f"{self.root}/commits/_{commit}.tmp")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps({"commit": commit, "tables": tables, "fresh": fresh, **about}).encode()))
        out.close()
        if not fs.rename(hidden, marker):
            raise OSError(f"the marker of commit {commit} could not be put in place")
        self._found = None

    def read(self, table: str, schema: str, last_only: bool = False) -> DataFrame:
        """The rows of the commits that count, with their ``commit`` and, if the schema has it, ``part`` (for pruning); ``last_only`` takes the last commit that has the table."""
        kind = StructType.fromDDL(schema)
        names = [m["commit"] for m in self.markers() if table in m["tables"]]
        if not names:
            return self.spark.createDataFrame([], kind)
        base = self.folder(table)
        paths = [f"{base}/commit={n}" for n in (names[-1:] if last_only else names)]
        with listed_by_few_tasks(self.spark):
            return self.spark.read.schema(kind).option("basePath", base).parquet(*paths)

    def holding(self, table: str, schema: str, key: str, wanted: DataFrame) -> DataFrame:
        """The distinct values of ``key`` that are both in the table and in ``wanted``.

        Only the parts that wanted's keys hash to are read, and only their key column. A large store's keys are filtered by a Bloom filter
        of wanted's before they move: Spark adds it to a join of this form when the sizes are worth it.
        """
        wanted = wanted.select(key).where(F.length(key) > 0).distinct()
        parts = [r["part"] for r in wanted.select(part_of(F.col(key)).alias("part")).distinct().collect()]  # PARTS numbers at most
        held = self.read(table, schema).where(F.col("part").isin(parts)).select(key)
        return held.join(wanted, key, "left_semi").distinct()

    def drop_unfinished(self, tables: list[str]) -> int:
        """Delete what commits without a marker have written; the number of folders. No import may be at work."""
        known, gone = {m["commit"] for m in self.markers()}, 0
        for table in tables:
            fs, folder = file_system(self.spark, self.folder(table))
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                name = status.getPath().getName()
                if name.startswith("commit=") and int(name.removeprefix("commit=")) not in known:
                    delete(self.spark, f"{self.folder(table)}/{name}")
                    gone += 1
        return gone


def _content(spark: SparkSession, fs, path) -> bytearray:
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
