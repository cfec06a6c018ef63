"""Rollups of nodes per file (an episode) and over all files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.text import has_text, or_default, stem

#: Sorts behind every date. Fixed value.
NO_DATE = "9999-99-99"
SUFFIX = ".processed_documents"
#: Stands for a missing date in a label. Fixed value.
UNDATED = "unknown date"


def node_counts(nodes: DataFrame) -> DataFrame:
    """(source_file, node_type, n); a null or empty type counts as unknown."""
    return nodes.groupBy("source_file", or_default(F.col("node_type"), "unknown").alias("node_type")).agg(F.count("*").alias("n"))


def episode_speakers(nodes: DataFrame) -> DataFrame:
    """Distinct (source_file, speaker)."""
    return nodes.select("source_file", F.explode("speakers").alias("speaker")).distinct()


def date_range(nodes: DataFrame, *by: str, unknown: str = "Unknown") -> DataFrame:
    """Smallest and largest non-empty date text, by value of text."""
    date = F.nullif(F.col("episode_date"), F.lit(""))
    return nodes.groupBy(*by).agg(F.coalesce(F.min(date), F.lit(unknown)).alias("start_date"), F.coalesce(F.max(date), F.lit(unknown)).alias("end_date"))


def _first(name: str) -> Column:
    """The first value in node order that is neither null nor empty."""
    value = F.nullif(F.col(name), F.lit(""))
    return F.min_by(value, F.when(value.isNotNull(), F.col("pos")))


def rollup(nodes: DataFrame) -> DataFrame:
    """One row per file: id, title, date, documents, insertable documents.

    The id is that of the first node with any metadata (not of a later one), else the file's stem; the
    title falls back to the file's own title and then to the stem without its fixed suffix.
    """
    with_metadata = F.when(F.col("has_metadata"), F.col("pos"))
    rows = nodes.groupBy("source_file").agg(
        F.min_by("episode_id", with_metadata).alias("_id"),
        _first("episode_title").alias("_title"),
        F.max("file_title").alias("_file_title"),
        F.coalesce(_first("episode_date"), F.lit("")).alias("episode_date"),
        F.count("*").alias("documents"),
        F.count_if(has_text(F.col("page_content"))).alias("insertable"),
    )
    name = stem(F.col("source_file"))
    plain = F.when(name.endswith(SUFFIX), F.substring(name, F.lit(1), F.length(name) - len(SUFFIX))).otherwise(name)
    return rows.select(
        "source_file",
        F.coalesce(F.nullif("_id", F.lit("")), name).alias("episode_id"),
        F.coalesce("_title", F.nullif("_file_title", F.lit("")), plain).alias("episode_title"),
        "episode_date",
        "documents",
        "insertable",
    )


def labels(rows: DataFrame, badges: DataFrame) -> DataFrame:
    """(source_file, label) of episodes: badge (source_file, badge), date or that it is unknown, and title."""
    badge = F.when(F.coalesce("badge", F.lit("")) == "", "").otherwise(F.concat("badge", F.lit(" ")))
    rows = rows.join(badges, "source_file", "left")
    return rows.select("source_file", F.concat(badge, or_default(F.col("episode_date"), UNDATED), F.lit(" - "), F.coalesce("episode_title", F.lit(""))).alias("label"))


def by_fingerprint(rows: DataFrame, fingerprint: str) -> DataFrame:
    """The episode with a fingerprint, the first by path if there are several; a filter that reaches the scan."""
    return rows.where(F.col("fingerprint") == fingerprint).orderBy("source_file").limit(1)


def display_order() -> list[Column]:
    """Episodes by date (none last), title in lower case, path."""
    return [or_default(F.col("episode_date"), NO_DATE), F.lower("episode_title"), F.col("source_file")]


def catalogue_order() -> list[Column]:
    """Manifest entries by date (none last), title as it is, path."""
    return [or_default(F.col("episode_date"), NO_DATE), F.col("episode_title"), F.col("source_file")]
