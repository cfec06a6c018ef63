"""Constraints on nodes, their violations, and a bounded digest of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.text import asks_for_source, has_text

#: Node types that must not ask for their source, and those that need a speaker scope. Fixed values.
GENERATED = ("cluster_summary", "episode_thesis", "position_card")
SCOPED = (*GENERATED, "leaf_chunk")
RULES = ("empty_content", "asks_for_source", "missing_node_id", "missing_episode_date", "missing_speaker_scope")
#: Violations named in a digest.
NAMED = 10


def _absent(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def broken_rules() -> Column:
    """The numbers (from 0) of the rules that a node breaks, in order."""
    text = F.col("page_content")
    kind = lambda kinds: F.coalesce(F.col("node_type").isin(*kinds), F.lit(False))
    checks = [
        ~has_text(text),
        has_text(text) & kind(GENERATED) & asks_for_source(text),
        _absent("node_id"),
        _absent("episode_date"),
        _absent("speaker_scope") & kind(SCOPED),
    ]
    return F.array_compact(F.array(*(F.when(check, F.lit(i)) for i, check in enumerate(checks))))


def violations(nodes: DataFrame) -> DataFrame:
    """(source_file, pos, rule_no, rule, label): a row for each rule that a node breaks."""
    rows = nodes.select("source_file", "pos", F.explode(broken_rules()).alias("rule_no"), "label")
    return rows.withColumn("rule", F.element_at(F.array(*map(F.lit, RULES)), F.col("rule_no") + 1))


def unreadable(files: DataFrame) -> DataFrame:
    """The columns of ``violations`` for files that cannot be read at all."""
    return files.select("source_file", F.lit(-1).alias("pos"), F.lit(-1).alias("rule_no"), F.lit("unreadable_json").alias("rule"), F.lit("file").alias("label"))


def file_validity(nodes: DataFrame) -> DataFrame:
    """(source_file, n_violations, valid) for every file that has nodes."""
    rows = nodes.groupBy("source_file").agg(F.sum(F.size(broken_rules())).alias("n_violations"))
    return rows.withColumn("valid", F.col("n_violations") == 0)


def digest(found: DataFrame, group: Column, name: str, named: int = NAMED) -> DataFrame:
    """(name, digest, more): the first violations of each group in a line, and how many more there are.

    The rank filter keeps at most ``named`` rows a group and task before the shuffle.
    """
    rows = found.withColumn(name, group)
    order = Window.partitionBy(name).orderBy("source_file", "pos", "rule_no")
    first = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= named)
    first = first.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(": ", "label", "rule").alias("text")))), lambda x: x["text"]), "; ").alias("digest"))
    totals = rows.groupBy(name).agg((F.greatest(F.count("*"), F.lit(named)) - named).alias("more"))
    return first.join(totals, name)
