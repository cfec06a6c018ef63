"""Exact top-k search: every query against every vector by integer inner products.

Queries are cut into blocks, vectors into shards; a block and a shard meet in a tile. A tile's task holds the block as one
matrix and multiplies it with its shard's vectors, batch by batch; of each product only scores that reach the block's lists so far
are looked at, so a tile gives at most k + 1 rows a query. The lists of a query's tiles are then merged in a tree of fixed
fan-in. Blocks are bounded by their bytes, shards by their rows.

Components are floor(256 * x). While the products of lengths show that no sum leaves the whole numbers that a float holds, the matrix
product is exact in that type (32 or 64 bits); beyond, whole numbers of any size are used. Scores that a long cannot hold are set to
its ends before they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import sized, stored, tidy

SCALE = 256
#: Bytes of a block of queries as 64-bit floats, vectors of a shard, least number of shards, vectors multiplied at once, lists merged in one step.
BLOCK_BYTES, SHARD, SPREAD, ROWS, FAN = 1 << 24, 1 << 14, 16, 1024, 16
_LONG = (1 << 63) - 1


def _taking_part(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, asks, size, h) of the rows that have an id and a vector of finite components."""
    vector = F.col(vector_col)
    if dict(vectors.dtypes)[vector_col] not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.withColumns({"size": F.size("vector"), "h": F.xxhash64("vector")})


def quantised(flat: np.ndarray, size: int) -> np.ndarray:
    return np.floor(SCALE * flat.astype(np.float64)).reshape(-1, size)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, as longs."""
    most = np.sqrt((queries**2).sum(1).max(initial=0)) * np.sqrt((vectors**2).sum(1).max(initial=0))
    if most < 1 << 23:  # no sum of some of a product's terms is larger than the product of the lengths
        return (queries.astype(np.float32) @ vectors.astype(np.float32).T).astype(np.int64)
    if most < 1 << 52:
        return (queries @ vectors.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in rows], object) for rows in (queries, vectors)]
    return np.clip(whole[0] @ whole[1].T, -_LONG, _LONG).astype(np.int64)


def own_scores(queries: np.ndarray) -> np.ndarray:
    """The score of each row for itself."""
    squares = (queries**2).sum(1)
    far = np.flatnonzero(squares >= 1 << 52)
    out = np.where(squares < 1 << 52, squares, 0).astype(np.int64)
    for i in far.tolist():
        out[i] = min(sum(int(x) ** 2 for x in queries[i]), _LONG)
    return out


class TopLists:
    """The best ``keep`` (score, id) of each query of a block so far: by score, ties by smaller id."""

    def __init__(self, queries: np.ndarray, keep: int) -> None:
        self.queries, self.keep = queries, keep
        self.worst = np.full(len(queries), -_LONG - 1, np.int64)
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = exact_scores(self.queries, vectors)
        worst = self.worst
        if len(ids) > self.keep:  # partial selection: what is below the batch's own best cannot stay either
            worst = np.maximum(worst, np.partition(scores, len(ids) - self.keep, axis=1)[:, len(ids) - self.keep])
        row, at = np.nonzero(scores >= worst[:, None])
        row, score, near = np.append(self.row, row), np.append(self.score, scores[row, at]), np.append(self.id, ids[at])
        order = np.lexsort((near, -score, row))
        row, score, near = row[order], score[order], near[order]
        heads = np.searchsorted(row, np.arange(len(self.queries)))
        kept = np.arange(len(row)) - heads[row] < self.keep
        self.row, self.score, self.id = row[kept], score[kept], near[kept]
        sizes = np.bincount(self.row, minlength=len(self.queries))
        full = np.flatnonzero(sizes == self.keep)
        self.worst[full] = self.score[np.cumsum(sizes)[full] - 1]


def tile_lists(tiles: DataFrame, keep: int) -> DataFrame:
    """(id, h, shard, own, top) per query and tile, from rows (size, block, shard, side, id, h, vector) with a tile's queries (side 0) first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], None

        def result() -> Iterator[pa.RecordBatch]:
            if lists is None or not len(lists.row):
                return
            sizes = np.bincount(lists.row, minlength=len(lists.queries))
            own = np.flatnonzero(sizes)
            keys = [np.concatenate([part[k] for part in held])[own] for k in (0, 1)]
            entries = pa.StructArray.from_arrays([pa.array(-lists.score), pa.array(lists.id)], ["less", "id"])
            top = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[own])).astype(np.int32)), entries)
            yield pa.record_batch([*map(pa.array, keys), pa.array(np.full(len(own), now[2], np.int32)), pa.array(own_scores(lists.queries[own])), top], ["id", "h", "shard", "own", "top"])

        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            size, block, shard, side, ids, hashes = (batch.column(c).to_numpy() for c in ("size", "block", "shard", "side", "id", "h"))
            vectors = batch.column("vector")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            cuts = np.flatnonzero(np.append(True, np.diff(size).astype(bool) | np.diff(block).astype(bool) | np.diff(shard).astype(bool) | np.diff(side).astype(bool)))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
                tile = (int(size[lo]), int(block[lo]), int(shard[lo]))
                if tile != now:
                    yield from result()
                    now, held, lists = tile, [], None
                # an empty vector's components are those of one that is zero
                rows = quantised(flat[ends[lo] : ends[hi]], tile[0]) if tile[0] else np.zeros((hi - lo, 1))
                if side[lo] == 0:
                    held.append((ids[lo:hi].copy(), hashes[lo:hi].copy(), rows))
                elif held:
                    lists = lists or TopLists(np.concatenate([part[2] for part in held]), keep)
                    lists.add(ids[lo:hi], rows)
        yield from result()

    return tiles.mapInArrow(tidy(work), "id long, h long, shard int, own long, top array<struct<less: long, id: long>>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` its k best other rows, best first.

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part, nor do rows without an
    id; vectors of another length than the query's are none of its candidates, and those of length 0 score 0. Rows that share an id are rows of their own: each
    is a query and a candidate of the others, only rows equal in id and vector are one query. A query with
    fewer than k candidates has them all; without any it has no row. An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    rows = _taking_part(vectors, is_query, id_col, vector_col)
    counts = rows.groupBy("size").agg(F.count("*").alias("rows"), F.count_if("asks").alias("asked")).where("asked > 0")
    blocks = F.ceil(8 * F.col("asked") * F.greatest("size", F.lit(1)) / BLOCK_BYTES)
    shards = F.greatest(F.least(F.lit(SPREAD), "rows"), F.ceil(F.col("rows") / SHARD))
    counts = stored(counts.select("size", blocks.cast("int").alias("blocks"), shards.cast("int").alias("shards")), "sizes")  # one row per length of vectors
    widest = counts.agg(F.max("shards")).first()[0] or 0
    dealt = rows.join(sized(counts), "size").withColumn("deal", F.xxhash64("h", "id"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod("deal", n).cast("int")
    asked = dealt.where("asks").dropDuplicates(["id", "vector"])
    left = asked.select("size", some("blocks").alias("block"), each("shards").alias("shard"), F.lit(0).alias("side"), "id", "h", "vector")
    right = dealt.select("size", each("blocks").alias("block"), some("shards").alias("shard"), F.lit(1), "id", "h", "vector")
    tiles = left.union(right).repartition("size", "block", "shard").sortWithinPartitions("size", "block", "shard", "side")
    lists = tile_lists(tiles, k + 1)  # the query itself may be among them
    while widest > 1:
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k + 1)
        lists = lists.groupBy("id", "h", F.floor(F.col("shard") / FAN).cast("int").alias("shard")).agg(F.first("own").alias("own"), best.alias("top"))
        widest = -(-widest // FAN)
    # of the entries with the query's id and its score for itself one is the query; in a list without any it is too far down
    itself = F.array_position(F.transform("top", lambda x: (x["id"] == F.col("id")) & (x["less"] == -F.col("own"))), True) - 1
    lists = lists.withColumn("itself", itself)
    others = F.slice(F.filter("top", lambda x, i: i != F.col("itself")), 1, k)
    found = lists.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "entry"))
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("entry.id").alias("vec_id"), (-F.col("entry.less")).alias("score"))
