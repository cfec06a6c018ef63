"""Configuration of imports and plans of exports: small values that the driver holds."""

from __future__ import annotations

import dataclasses
import json
import os
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.text import DEFAULT_FOLDER, or_default, parent_name, slug


@dataclasses.dataclass
class ImportConfig:
    """The nine settings of an import. Defaults are fixed values."""

    processed_data_dir: str = "processed_data"
    file_glob: str = "**/*.processed_documents.json"
    state_path: str = "state/import_state"
    persist_dir: str = "store"
    collection_name: str = "nodes"
    embedding_model: str = "hash-64"
    import_batch_size: int = 64
    skip_existing_ids: bool = True
    stop_file: str = "STOP"

    def __post_init__(self) -> None:
        if self.import_batch_size < 1:
            raise ValueError("import_batch_size is at least 1")


def load_config(path: str | None, **overrides: str | None) -> ImportConfig:
    """Known keys of a JSON file (none: defaults), then the overrides that are not empty."""
    known = {f.name for f in dataclasses.fields(ImportConfig)}
    found = json.loads(Path(path).read_text("utf-8")) if path and Path(path).exists() else {}
    return ImportConfig(**{k: v for k, v in {**found, **{k: v for k, v in overrides.items() if v}}.items() if k in known})


def resolve(base: str, value: str) -> str:
    """A path with ~ expanded, relative ones below ``base``; URIs stay as they are."""
    return value if "://" in value else str(Path(base) / Path(os.path.expanduser(value)))


#: What an export falls back to. Fixed value, and the names of this library's own defaults.
NAMELESS, COLLECTION, MODEL, DEVICE = "Podcast Chat Export", ImportConfig.collection_name, ImportConfig.embedding_model, "auto"


def device(value: str) -> str:
    """A device's name in its usual form: nothing is automatic, the first of a kind has a number."""
    name = value.strip().lower() or DEVICE
    return "cuda:0" if name == "cuda" else name


@dataclasses.dataclass
class ExportPlan:
    """What an export is asked for; the members of a settings document."""

    podcast_name: str = ""
    database_id: str = ""
    processed_data_dir: str = ""
    output_root: str = ""
    collection_name: str = ""
    embedding_model: str = ""
    embedding_device: str = ""

    @classmethod
    def of(cls, head: dict[str, str]) -> ExportPlan:
        """The known members of a settings document; a missing name is that of a nameless export."""
        own = {f.name: str(head.get(f.name) or "") for f in dataclasses.fields(cls)}
        return cls(**{**own, "podcast_name": own["podcast_name"] or NAMELESS})

    def missing(self, files: int) -> list[str]:
        """What has to be done before an export can start, in the order in which a form asks for it. Fixed values."""
        asks = (
            (self.processed_data_dir, "choose a processed RAG output folder"),
            (self.output_root, "choose an output folder"),
            (files, "load at least one processed episode file"),
            (self.podcast_name.strip(), "enter a podcast name"),
            (self.collection_name.strip(), "enter a collection"),
            (self.embedding_model.strip(), "enter an embedding model"),
        )
        return [text for there, text in asks if not there]

    def filled(self, spark: SparkSession) -> ExportPlan:
        """With defaults for what is empty; the id is made from the name."""
        name = self.podcast_name.strip()
        made = self.database_id.strip() or spark.range(1).select(slug(F.lit(name))).first()[0]
        return dataclasses.replace(self, podcast_name=name, database_id=made, collection_name=self.collection_name.strip() or COLLECTION, embedding_model=self.embedding_model.strip() or MODEL, embedding_device=device(self.embedding_device))

    def named_after(self, spark: SparkSession) -> ExportPlan:
        """With a name, if it has none: that of the folder above the processed files."""
        if self.podcast_name.strip():
            return self
        found = spark.range(1).select(or_default(parent_name(F.lit(self.processed_data_dir)), DEFAULT_FOLDER)).first()[0]
        return dataclasses.replace(self, podcast_name=found)

    def about(self) -> dict[str, str]:
        """The head of a manifest."""
        own = dataclasses.asdict(self)
        return {k: own[k] for k in ("database_id", "collection_name", "embedding_model", "embedding_device")} | {"description": f"Generated from processed RAG output in {self.processed_data_dir}"}
