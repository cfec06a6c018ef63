"""Files still to import, ids still to insert, embedding and upsert."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts to vectors; called once per batch in a worker.
Embedder = Callable[[list[str]], np.ndarray]


def pending_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose fingerprint is not completed: new, changed and failed ones."""
    return files.join(ledger.where("status = 'completed'").select("fingerprint"), "fingerprint", "left_anti")


def existing_nodes(nodes: DataFrame, store: DataFrame) -> DataFrame:
    return nodes.join(store.select("node_id"), "node_id", "left_semi")


def pending_nodes(nodes: DataFrame, store: DataFrame) -> DataFrame:
    """Nodes whose id is not stored. Comes before embedding, so stored nodes are never embedded again."""
    return nodes.join(store.select("node_id"), "node_id", "left_anti")


def hash_embedder(size: int = 64) -> Embedder:
    """A model-free embedder: signed hashes of words, scaled to length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        words = [text.lower().split() for text in texts]
        number = {word: k for k, word in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)))}  # each is hashed once
        hashes = np.array([int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big") for word in number], np.uint64)
        at = np.fromiter((number[word] for own in words for word in own), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        place, sign = (hashes % np.uint64(size)).astype(np.int64), np.where(hashes >> np.uint64(63), 1, -1).astype(np.float32)
        np.add.at(out, (row, place[at]), sign[at])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


#: Embedders by name, made on the driver and sent to the tasks; add a model's factory here to configure it by name.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {}


def named_embedder(name: str) -> Embedder:
    """The embedder of a configuration: ``hash-N`` is the model-free one with N dimensions, others must be in EMBEDDERS."""
    if name in EMBEDDERS:
        return EMBEDDERS[name]()
    if found := re.fullmatch(r"hash-([1-9][0-9]*)", name):
        return hash_embedder(int(found[1]))
    raise ValueError(f"no embedder is named {name!r}: add its factory to nodeloom.operators.store.EMBEDDERS")


def embedded(nodes: DataFrame, embedder: Embedder, batch_size: int = 64) -> DataFrame:
    """nodes with ``embedding``; the embedder gets at most ``batch_size`` texts at once."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            parts = [embedder(texts[lo : lo + batch_size]) for lo in range(0, len(texts), batch_size)]
            yield pd.Series([row for part in parts for row in part], dtype=object)

    return nodes.withColumn("embedding", embed("page_content"))


def text_digest(text: Column, model: str) -> Column:
    """What a vector is stored by: the model's name and the text."""
    return F.unhex(F.sha2(F.concat(F.lit(f"{model}\n"), F.coalesce(text, F.lit(""))), 256))


def new_texts(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, page_content) of the texts of nodes(digest, page_content) that ``known`` (digest) does not name: each once, however many nodes have it."""
    fresh = nodes.select("digest", "page_content").join(known.select("digest"), "digest", "left_anti")
    return fresh.groupBy("digest").agg(F.first("page_content").alias("page_content"))


def with_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """nodes(digest) with the ``embedding`` of their text."""
    return nodes.join(vectors.groupBy("digest").agg(F.first("embedding").alias("embedding")), "digest", "left")


def fresh_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    """(node_id, source_file) of ids(node_id, source_file) that are inserted: ids that ``known`` (node_id) lacks, in the first file that has them."""
    return ids.groupBy("node_id").agg(F.min("source_file").alias("source_file")).join(known.select("node_id"), "node_id", "left_anti")


def last_by_id(rows: DataFrame) -> DataFrame:
    """One row per node_id: the last in file and node order."""
    order = F.struct("source_file", "pos")
    return rows.groupBy("node_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "node_id"]), order).alias("_row")).select("node_id", "_row.*")


def upserted(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store's rows that ``rows`` does not replace, and ``rows``."""
    return store.join(rows.select("node_id"), "node_id", "left_anti").unionByName(rows.select(*store.columns))


def import_counts(nodes: DataFrame, store: DataFrame) -> DataFrame:
    """One row: documents, inserted, and the number of distinct ids that were stored before."""
    known = store.select("node_id").distinct().withColumn("_known", F.lit(True))
    rows = nodes.join(known, "node_id", "left")
    stored: Column = F.col("_known").isNotNull()
    return rows.agg(F.count("*").alias("documents"), F.count_if(~stored).alias("inserted"), F.count_distinct(F.when(stored, F.col("node_id"))).alias("skipped_existing"))
