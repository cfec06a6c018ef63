"""Which speakers of which files are selected, as a table (source_file, speaker), and the nodes that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["source_file", "speaker"]


def _none() -> Column:
    return F.array().cast("array<string>")


def included(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    """The nodes to take: whole-episode nodes, summaries over several speakers, nodes without speakers, and
    nodes with a selected speaker. A file without a selection selects nobody."""
    chosen = selection.where("speaker is not null").groupBy("source_file").agg(F.collect_set("speaker").alias("_chosen"))
    kind, scope = F.coalesce("node_type", F.lit("")), F.coalesce("speaker_scope", F.lit(""))
    keep = (kind == "episode_thesis") | ((kind == "cluster_summary") & (scope != "single")) | (F.size("speakers") == 0)
    rows = nodes.join(chosen, "source_file", "left")
    return rows.where(keep | F.arrays_overlap("speakers", F.coalesce("_chosen", _none()))).drop("_chosen")


def effective(speakers: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected speakers that a file really has."""
    return speakers.join(selection.select(*KEYS), KEYS, "left_semi")


def with_defaults(speakers: DataFrame, selection: DataFrame, saved: DataFrame) -> DataFrame:
    """selection, and all speakers of files that ``saved`` (source_file) does not name.

    A file that is saved with an empty selection keeps it empty.
    """
    missing = speakers.join(saved.select("source_file"), "source_file", "left_anti")
    kept = selection.join(saved.select("source_file"), "source_file", "left_semi")
    return kept.select(*KEYS).union(missing.select(*KEYS)).distinct()


def set_speakers(speakers: DataFrame, selection: DataFrame, on: bool, speaker: str | None = None, source_file: str | None = None) -> DataFrame:
    """Select (or drop) one speaker or all, in one file or in all that have them."""
    which = F.lit(True)
    if speaker is not None:
        which = which & (F.col("speaker") == speaker)
    if source_file is not None:
        which = which & (F.col("source_file") == source_file)
    rest = selection.select(*KEYS)
    if on:
        return rest.union(speakers.where(which).select(*KEYS)).distinct()
    return rest.where(~F.coalesce(which, F.lit(False))).distinct()


def tristate(speakers: DataFrame, selection: DataFrame) -> DataFrame:
    """(speaker, state) over the files that have the speaker: checked, partial or unchecked."""
    mark = selection.select(*KEYS).distinct().withColumn("on", F.lit(True))
    rows = speakers.join(mark, KEYS, "left").withColumn("on", F.coalesce("on", F.lit(False)))
    state = F.when(F.bool_and("on"), "checked").when(F.bool_or("on"), "partial").otherwise("unchecked")
    return rows.groupBy("speaker").agg(state.alias("state"))
