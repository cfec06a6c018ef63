"""Data sources by format name: ``nodeloom`` reads and writes a store's tables, ``nodeloom_files`` streams files that are new or have changed.

Register them with ``register(spark)``. Both work on any file system that Arrow opens.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from nodeloom.sources.commits import PARTS

#: Tables of a store, without commit and part, and the columns by which rows are dealt to parts.
TABLES = {
    "rows": "node_id string, source_file string, pos int, page_content string, metadata_json string, digest binary",
    "vectors": "digest binary, embedding array<float>",
    "entries": "source_file string, source_fingerprint string, episode_id string, episode_title string, episode_date string, document_count bigint, imported_at timestamp",
    "speakers": "source_file string, speaker string, speaker_id string",
}
KEYS = {"rows": "node_id", "vectors": "digest"}
#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20


def part_number(key: str | bytes | None) -> int:
    """The part that Spark's ``part_of`` deals a key to."""
    if key is None:
        return 42 % PARTS  # Spark hashes a null to the seed
    data = key.encode() if isinstance(key, str) else key
    return (xxhash.xxh64_intdigest(data, seed=42) ^ (1 << 63)) % PARTS if PARTS & (PARTS - 1) else xxhash.xxh64_intdigest(data, seed=42) & (PARTS - 1)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.rstrip("/"))


def _markers(files: fs.FileSystem, root: str) -> list[dict]:
    """As ``Commits.markers``."""
    listed = files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    found = sorted((json.loads(files.open_input_stream(x.path).read()) for x in listed if x.path.endswith(".json")), key=lambda m: m["commit"])
    fresh = max((k for k, m in enumerate(found) if m["fresh"]), default=0)
    return found[fresh:]


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


class TableReader(DataSourceReader):
    """One task reads some files of the commits that count when the read is planned."""

    def __init__(self, path: str, table: str, schema: StructType) -> None:
        self.path, self.table, self.schema = path, table, schema

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.path)
        groups, size = [[]], 0
        for marker in _markers(files, root):
            if self.table not in marker["tables"]:
                continue
            for x in files.get_file_info(fs.FileSelector(f"{root}/{self.table}/commit={marker['commit']}", recursive=True)):
                if x.is_file and x.path.endswith(".parquet"):
                    if groups[-1] and size + x.size > TASK_BYTES:
                        groups.append([])
                        size = 0
                    groups[-1].append((x.path, marker["commit"]))
                    size += x.size
        return [Files(group) for group in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        files, _ = _open(self.path)
        wanted = to_arrow_schema(self.schema)
        for name, commit in partition.names:
            with files.open_input_file(name) as source:
                for batch in pq.ParquetFile(source).iter_batches(columns=[c for c in wanted.names if c != "commit"]):
                    columns = [pa.array([commit] * batch.num_rows, pa.int64()) if f.name == "commit" else batch.column(f.name).cast(f.type) for f in wanted]
                    yield pa.record_batch(columns, schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TableWriter(DataSourceArrowWriter):
    """Tasks write files of their own into the folder of a new commit; ``commit`` keeps those of the tasks that count and puts the marker in place."""

    def __init__(self, path: str, table: str, overwrite: bool) -> None:
        files, root = _open(path)
        self.path, self.table, self.overwrite = path, table, overwrite
        self.number = max(time.time_ns(), max((m["commit"] for m in _markers(files, root)), default=0) + 1)

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        files, root = _open(self.path)
        return files, root, f"{root}/{self.table}/commit={self.number}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, folder = self._folder()
        writers: dict[str, tuple] = {}
        for batch in iterator:
            batch = pa.Table.from_batches([batch])
            key = KEYS.get(self.table)
            if key is None:
                pieces = {"": batch}
            else:
                parts = pa.array([part_number(k) for k in batch.column(key).to_pylist()], pa.int32())
                pieces = {f"/part={k}": batch.filter(pa.compute.equal(parts, k)) for k in parts.unique().to_pylist()}
            for where, rows in pieces.items():
                if where not in writers:
                    files.create_dir(f"{folder}{where}", recursive=True)
                    name = f"{folder}{where}/{uuid.uuid4().hex}.parquet"
                    sink = files.open_output_stream(name)
                    writers[where] = (name, sink, pq.ParquetWriter(sink, rows.schema, compression="zstd"))
                writers[where][2].write_table(rows)
        for _, sink, writer in writers.values():
            writer.close()
            sink.close()
        return Written([name for name, _, _ in writers.values()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root, folder = self._folder()
        kept = {name for m in messages if m is not None for name in m.names}
        files.create_dir(folder, recursive=True)
        for x in files.get_file_info(fs.FileSelector(folder, recursive=True)):
            if x.is_file and x.path not in kept:  # of tasks that ran twice
                files.delete_file(x.path)
        files.create_dir(f"{root}/commits", recursive=True)
        with files.open_output_stream(f"{root}/commits/_{self.number}.tmp") as out:
            out.write(json.dumps({"commit": self.number, "tables": [self.table] if kept else [], "fresh": self.overwrite}).encode())
        files.move(f"{root}/commits/_{self.number}.tmp", f"{root}/commits/{self.number}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _, folder = self._folder()
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class StoreSource(DataSource):
    """``format("nodeloom")``, with the store as path and ``table`` as option (rows if none is given): one write is one commit."""

    @classmethod
    def name(cls) -> str:
        return "nodeloom"

    def _table(self) -> str:
        table = self.options.get("table", "rows")
        if table not in TABLES:
            raise ValueError(f"a store has no table {table!r}, but {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return f"{TABLES[self._table()]}, commit bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TableReader(self.options["path"], self._table(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) != TABLES[self._table()]:
            raise ValueError(f"the columns of {self._table()} are {TABLES[self._table()]}")
        return TableWriter(self.options["path"], self._table(), overwrite)


def file_uri(path: str) -> str:
    """A local path as Spark names files; other characters than these stay."""
    return "file:" + re.sub(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]""", lambda m: quote(m[0], safe=""), path)


class ChangedFilesReader(DataSourceStreamReader):
    """Files whose fingerprint (path, size, time) has not been seen: new ones, and those that were rewritten.

    An offset is the number of a log; log N names the files that the listing behind offset N - 1 brought. Logs are kept below ``state``, so a
    restarted query knows what it has seen, and a batch that is run again gets the same files (with what is in them by then).
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.state = options["path"], options["state"]
        self.glob = options.get("fileglob", "**/*")
        self.per_task = int(options.get("filespertask", "64"))
        self.seen: set[str] | None = None
        self.last = 0

    def _logs(self) -> tuple[fs.FileSystem, str, list[int]]:
        files, folder = _open(self.state)
        listed = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return files, folder, sorted(int(PurePosixPath(x.path).stem) for x in listed if x.path.endswith(".json"))

    def _log(self, number: int) -> list[list]:
        files, folder = _open(self.state)
        return json.loads(files.open_input_stream(f"{folder}/{number}.json").read())

    def _listed(self) -> Iterator[tuple[str, str]]:
        files, base = _open(self.path)
        for x in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            inside = PurePosixPath(x.path).relative_to(base)
            if x.is_file and not any(p.startswith((".", "_")) for p in inside.parts) and inside.full_match(self.glob):
                yield x.path, f"{x.path}|{x.size}|{x.mtime_ns}"

    def initialOffset(self) -> dict:
        return {"log": 0}

    def latestOffset(self) -> dict:
        if self.seen is None:
            _, _, logs = self._logs()
            self.seen = {mark for k in logs for _, mark in self._log(k)}
            self.last = max(logs, default=0)
        fresh = sorted((path, mark) for path, mark in self._listed() if mark not in self.seen)
        if fresh:
            files, folder = _open(self.state)
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/_{self.last + 1}.tmp") as out:
                out.write(json.dumps(fresh).encode())
            files.move(f"{folder}/_{self.last + 1}.tmp", f"{folder}/{self.last + 1}.json")
            self.last += 1
            self.seen.update(mark for _, mark in fresh)
        return {"log": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = [tuple(x) for k in range(start["log"] + 1, end["log"] + 1) for x in self._log(k)]
        return [Files(names[lo : lo + self.per_task]) for lo in range(0, len(names), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple[str, str, str | None]]:
        files, _ = _open(self.path)
        local = isinstance(files, fs.LocalFileSystem)
        for path, mark in partition.names:
            text = None  # the file is gone
            if files.get_file_info(path).is_file:
                with files.open_input_stream(path) as source:
                    text = source.read().decode("utf-8", "replace")
            yield (file_uri(path) if local else path, mark, text)


class ChangedFilesSource(DataSource):
    """``format("nodeloom_files")``: a stream (source_file, fingerprint, value) of the files below a path, whole, again whenever they change.

    Options: ``state`` (a folder for what was seen, of this query alone), ``fileGlob`` (below the path; ``**`` stands for any depth), ``filesPerTask``.
    """

    @classmethod
    def name(cls) -> str:
        return "nodeloom_files"

    def schema(self) -> str:
        return "source_file string, fingerprint string, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangedFilesReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    for kind in (StoreSource, ChangedFilesSource):
        spark.dataSource.register(kind)
