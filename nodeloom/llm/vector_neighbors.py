"""Embedding near-dedup by cross-polytope hashing.

A hash rotates the unit vector by three rounds of random signs and a fast Hadamard transform and takes the nearest
of the 2d signed axes. A table's bucket is the label, the dimension and ``HASHES`` such hashes. Each vector is at home in
one bucket of each of ``TABLES`` tables and also visits the buckets that differ in one hash by the runner-up
axis, cheapest first (``PROBES`` of them). Vectors that meet, one of them at home, are compared by cosine in double
precision; a pair counts in the first table, and there in one bucket, in which it meets.

Equal vectors are one class with a multiplicity. A bucket of more than ``BLOCK`` members is cut into blocks
that meet two by two; a task keeps two blocks at most and returns counts and a forest of links, never
the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from nodeloom.llm.common import connected_components, sized, stored, tidy

TABLES, HASHES, PROBES, BLOCK = 8, 2, 2, 1024


class Rotations:
    """The fixed random rotations for one dimension (a power of two)."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.signs = np.random.default_rng([20240511, size]).choice([-1.0, 1.0], (TABLES * HASHES, 3, size))

    def axes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest axis, runner-up axis, gap) of each row for each hash."""
        best, second, gap = (np.empty((len(x), TABLES * HASHES), t) for t in (np.int64, np.int64, float))
        for k, rounds in enumerate(self.signs):
            y = x
            for signs in rounds:
                y = hadamard(y * signs)
            size = np.abs(y)
            rows = np.arange(len(x))
            first = size.argmax(1)
            top = size[rows, first].copy()
            size[rows, first] = -1
            other = size.argmax(1)
            best[:, k] = first * 2 + (y[rows, first] < 0)
            second[:, k] = other * 2 + (y[rows, other] < 0)
            gap[:, k] = top - size[rows, other]
        return best, second, gap


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform of the rows."""
    n = x.shape[1]
    width = 1
    while width < n:
        y = x.reshape(len(x), n // (2 * width), 2, width)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        width *= 2
    return x / np.sqrt(n)


_rotations: dict[int, Rotations] = {}


def buckets(vectors: np.ndarray) -> np.ndarray:
    """The bucket keys of unit vectors: [row, table, 0] is home, the others are visits (-1: none)."""
    d = vectors.shape[1]
    size = max(2, 1 << (d - 1).bit_length())
    if size not in _rotations:
        _rotations[size] = Rotations(size)
    best, second, gap = (a.reshape(len(vectors), TABLES, HASHES) for a in _rotations[size].axes(np.pad(vectors, ((0, 0), (0, size - d)))))
    base = 2 * size
    powers = base ** np.arange(HASHES)
    home = (best * powers).sum(2)
    keys = np.full((len(vectors), TABLES, 1 + PROBES), -1, np.int64)
    keys[:, :, 0] = home
    order = gap.argsort(2)[:, :, :PROBES]
    change = np.take_along_axis((second - best) * powers, order, 2)
    keys[:, :, 1 : 1 + order.shape[2]] = home[:, :, None] + change
    return np.where(keys < 0, -1, keys % ((1 << 31) - 1)).astype(np.int32)  # only beyond 16,384 dimensions do buckets fall together


def units(rows: np.ndarray) -> np.ndarray:
    """The rows (finite, none of them zero) in double precision with length one."""
    x = rows.astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a list column without nulls."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def meetings(classes: DataFrame) -> DataFrame:
    """A row (label, dim, tab, bucket, home) plus the class's columns (node, m, v) for each bucket that it is in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            flat, ends = _flat(batch.column("v"))
            sizes = np.diff(ends)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                keys = buckets(units(flat[(ends[own][:, None] + np.arange(d)).ravel()].reshape(len(own), d)))
                at = np.argwhere(keys >= 0)
                part = batch.take(pa.array(own[at[:, 0]]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * keys[0].size), pa.array(keys.reshape(len(own), -1)[at[:, 0]].ravel()))
                columns = [part.column(c) for c in ("node", "label", "m", "v")]
                more = [pa.array(np.full(len(at), d, np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(keys[tuple(at.T)]), pa.array(at[:, 2] == 0), lists]
                yield pa.record_batch(columns + more, ["node", "label", "m", "v", "dim", "tab", "bucket", "home", "keys"])

    kind = dict(classes.dtypes)["v"]
    return classes.select("node", "label", "m", "v").mapInArrow(tidy(work), f"node long, label long, m long, v {kind}, dim int, tab int, bucket int, home boolean, keys array<int>")


def compare(tab: int, bucket: int, a: dict, b: dict | None, least: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(links per id, forest of links) of the members a of a bucket, or of a against b."""
    other = b or a
    cosines = a["x"] @ other["x"].T
    close = (cosines >= least - 1e-9) & (a["home"][:, None] | other["home"][None, :])
    if b is None:
        close &= np.triu(np.ones(close.shape, bool), 1)
    i, j = np.nonzero(close)
    if len(i):
        ok = (a["x"][i] * other["x"][j]).sum(1) >= least  # the same sum in every place where a pair meets
        i, j = i[ok], j[ok]
    if not len(i):
        return [], []
    p, q = a["keys"][i], other["keys"][j]  # [pair, table, probe]
    at_p = (p[:, :, :1] == q).any(2)
    at_q = (q[:, :, :1] == p).any(2)
    first = (at_p | at_q).argmax(1)
    # within the first table the home of the smaller id counts, if the other is there, else the other's home
    rows = np.arange(len(i))
    small = a["id"][i] < other["id"][j]
    homes = np.where(small, p[rows, first, 0], q[rows, first, 0])
    there = np.where(small, at_p[rows, first], at_q[rows, first])
    counted = (first == tab) & (bucket == np.where(there, homes, np.where(small, q[rows, first, 0], p[rows, first, 0])))
    n = len(a["id"])
    links = np.bincount(i[counted], other["m"][j[counted]], n), np.bincount(j[counted], a["m"][i[counted]], len(other["id"]))
    total = [(int(x), int(c)) for ids, sums in ((a["id"], links[0]), (other["id"], links[1])) for x, c in zip(ids, sums, strict=True) if c]
    ids = np.unique(np.append(a["id"][i], other["id"][j]))
    u, v = np.searchsorted(ids, a["id"][i]), np.searchsorted(ids, other["id"][j])
    top = np.arange(len(ids))
    while True:
        low = top.copy()
        np.minimum.at(low, u, top[v])
        np.minimum.at(low, v, top[u])
        low = low[low]
        if (low == top).all():
            break
        top = low
    return total, [(int(x), int(y)) for x, y in zip(ids, ids[top], strict=True) if x != y]


def found_links(rows: DataFrame, least: float) -> DataFrame:
    """(node, n, other) from the bucket rows: n adds to the links of node, other (if not null) is linked with it."""
    bucket = ["label", "dim", "tab", "bucket"]
    large = rows.groupBy(*bucket).agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).withColumn("blocks", F.ceil(F.col("c") / BLOCK)).drop("c")
    rows = rows.join(sized(stored(large, "large-buckets")), bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
    keys = [*bucket, "lo", "hi"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        held: list[tuple[np.ndarray, ...]] = []

        def done() -> tuple[list, list]:
            if sum(len(h[0]) for h in held) < 2:
                return [], []
            block, node, many, home, lists, x = (np.concatenate(part) for part in zip(*held, strict=True))
            x, sides = units(x), []
            for side in (now[4], now[5]) if now[4] != now[5] else (now[4],):
                own = block == side
                sides.append({"id": node[own], "m": many[own].astype(float), "home": home[own], "keys": lists[own].reshape(-1, TABLES, 1 + PROBES), "x": x[own]})
            if any(not len(s["id"]) for s in sides):
                return [], []
            return compare(now[2], now[3], sides[0], sides[1] if len(sides) > 1 else None, least)

        def told(totals: list, forest: list) -> pa.RecordBatch:
            nodes = [x for x, _ in totals] + [x for x, _ in forest]
            return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([c for _, c in totals] + [0] * len(forest), pa.int64()), pa.array([None] * len(totals) + [y for _, y in forest], pa.int64())], ["node", "n", "other"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in keys]
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "node", "m", "home")]
            (lists, _), (flat, ends) = _flat(batch.column("keys")), _flat(batch.column("v"))
            lists = lists.reshape(batch.num_rows, -1)
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            cuts = np.append(np.flatnonzero(new), batch.num_rows)
            # a bucket of one row has no pairs; the first and the last one may go on in other batches
            cuts = [(a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b - a > 1 or k in (0, len(cuts) - 2)]
            totals, forest = [], []
            for a, b in cuts:
                key = tuple(int(c[a]) for c in columns)
                if key != now:
                    for part, more in zip((totals, forest), done(), strict=True):
                        part += more
                    now, held = key, []
                held.append((*(c[a:b].copy() for c in own), lists[a:b].copy(), flat[ends[a] : ends[b]].reshape(b - a, -1).copy()))
            yield told(totals, forest)
        yield told(*done())

    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.select(*keys, "block", "node", "m", "home", "keys", "v").mapInArrow(tidy(work), "node long, n long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Only vectors with equal non-null labels and equal dimensions are compared. Vectors that are null, empty,
    zero, or hold null or non-finite values link with nothing. A row with a null id counts for others, has a null component_id
    and is not kept. Rows that share an id each count, and each has the links of its own vector. Vectors of doubles stay doubles. An
    empty table gives an empty result; other columns are ignored.
    """
    kind = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(whole & F.col("label").isNotNull(), F.lit(False))
    # -0.0 equals 0.0
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind[6:-1]))).withColumn("k", F.when(usable, F.sha2(F.to_json(F.struct("label", "v")).cast("binary"), 256)))
    classes = rows.where("k is not null").groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    # a class is a node named by its smallest id, or by a hash if it has none or another class has the same
    shared = classes.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit(1).alias("shared"))
    classes = classes.join(sized(shared), "id", "left").withColumn("node", F.when(F.col("shared").isNull() & F.col("id").isNotNull(), F.col("id")).otherwise(F.xxhash64("k")))
    classes = stored(classes.select("k", "id", "m", "label", "v", "node"), "vector-classes")
    found = stored(found_links(meetings(classes), least), "vector-links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    tops = classes.select("k", "id", "m", "node").join(links, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_ids = tops.groupBy("component").agg(F.min("id").alias("top"))
    tops = tops.join(least_ids, "component").select("k", "m", "n", "top")
    out = rows.select("id", "k").join(tops, "k", "left")
    top = F.when(F.col("id").isNotNull(), F.coalesce("top", "id"))
    n = F.coalesce(F.col("m") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), n.alias("n_links"), top.alias("component_id"), F.coalesce(F.col("id") == top, F.lit(False)).alias("kept"))
