"""Shared pieces: scratch tables in the cluster's shared folder, sized joins, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.sources.shared import scratch, shared_root

#: Rows up to which the side of a join counts as small enough to broadcast (checked by a count).
BROADCAST_ROWS = 100_000
#: Seconds of work between two scratch tables after which the driver collects its garbage.
COLLECT_EVERY = 15.0
_collected = time.monotonic()


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop what no step needs any more, if it has worked for COLLECT_EVERY seconds since it last did.

    What large tables make it gather (events of tasks, results, plans) else fills its heap up to the limit, and the broadcasts and
    shuffle files of steps that are over stay until then.
    """
    global _collected
    if time.monotonic() - _collected >= COLLECT_EVERY:
        gc.collect()  # Python's handles of Java objects keep those alive
        spark.sparkContext._jvm.java.lang.System.gc()
        _collected = time.monotonic()


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a scratch table and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this library; call it when no result is needed any more."""
    delete(spark, f"{shared_root(spark)}/nodeloom")


class Scratch:
    """The scratch tables of one run, each deleted once what it led to is stored elsewhere."""

    def __init__(self, spark: SparkSession, name: str, dictionary: bool = True) -> None:
        """``dictionary``: whether files may hold columns as dictionaries, which cost more than they save where values are hashes."""
        self.spark, self.folder, self.paths, self.dictionary = spark, scratch(spark, name), {}, dictionary

    def store(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = self.paths[name] = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).option("parquet.enable.dictionary", str(self.dictionary).lower()).parquet(path)
        collect_garbage(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the last tables of these names (none given: all tables)."""
        for path in [self.paths.pop(name) for name in names] or [self.folder]:
            delete(self.spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores behind it until df has no such column (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bits_for(rows: int, most: int, spare: int = 16) -> int:
    """Bits (as a power of two, 2**15 to 2**most) of a bitmap in which ``rows`` values fill one of ``spare`` at most, if they may."""
    return min(most, max(15, (spare * rows).bit_length()))


def bitmap_of(rows: DataFrame, position: Column, bits: int) -> bytes:
    """A bitmap of 2**bits bits in which the bits at the values of ``position`` (0 to 2**bits - 1) are set.

    Its size does not depend on the rows. Used as a prefilter in front of an exact join or
    count: a bit set by another value only costs rows, never a wrong result.
    """
    parts = (
        rows.select((position + F.lit(1)).alias("p"))  # Spark numbers the bits of a bitmap from 1
        .groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bitmap"))
        .collect()  # at most 2**bits / 32768 rows of 4 KB
    )
    out = bytearray(max(4096, 1 << (bits - 3)))
    for part in parts:
        at = (part["bucket"] - 1) * 4096
        out[at : at + 4096] = part["bitmap"]
    return bytes(out)


def in_bitmap(bits: bytes, at: Column) -> Column:
    """Whether the bit at the place ``at`` (a long) is set."""
    table = np.frombuffer(bits, np.uint8)

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        return pd.Series((table[at.to_numpy() >> 3] >> (at.to_numpy() & 7)) & 1 == 1)

    return once(marked)(at)


def once(function: Callable) -> Callable:
    """A Python function that Spark neither copies to other places of the plan nor calls twice for a row, as it may with one that it takes for cheap."""
    return function.asNondeterministic()


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: What work keeps in its worker process for its later tasks, by name.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in this process until other work lets it go."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def let_go(prefix: str | None) -> None:
    """Drop what this process keeps under names that do not start with ``prefix`` (None: all of it)."""
    gone = [name for name in _kept if prefix is None or not name.startswith(prefix)]
    for name in gone:
        del _kept[name]
    if gone:
        gc.collect()
        give_back()


def tidy(work: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """``work`` over a partition's batches; the memory that it leaves free goes back to the system, as the worker process lives on.

    What other work has kept there (all but names that start with ``keeps``) goes before it starts.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        let_go(keeps)
        yield from work(batches)
        give_back()

    return run


def may_be_among(rows: DataFrame, key: Column, own: Column, most: int) -> Column:
    """Whether ``own`` may be among the values ``key`` of rows: never false for one that is."""
    bits = bits_for(rows.count(), most)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    return in_bitmap(bitmap_of(rows, place(key), bits), place(own))


def forest(edges: DataFrame) -> DataFrame:
    """(u, v) edges with the components of ``edges``: each task replaces its rows by a forest of stars to the smallest node.

    No shuffle; a task holds the nodes of its own rows only.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := top.setdefault(x, x)) != x:
                top[x] = top[up]
                x = up
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    top[max(a, b)] = min(a, b)
        nodes = [x for x in top if root(x) != x]
        for lo in range(0, len(nodes), 1 << 16):
            part = nodes[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])

    return edges.mapInArrow(work, "u long, v long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` (64-bit ids); component is the smallest node reachable.

    Rounds of a forest per task and of large-star and small-star steps, written as minima per node: grouped aggregates and
    joins, so no neighbour list is gathered anywhere. They end when every node hangs on one node that hangs on
    none; every round is a scratch table. Null ends are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = stored(forest(e), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        e = stored(forest(e), "edges")
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", "m")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(down).where("u <> v").distinct()
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
