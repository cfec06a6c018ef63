"""The manifest: entries per file, lookup, the decision to skip, badges, merge and header.

Entries are (source_file, source_fingerprint, episode_id, episode_title, episode_date, document_count);
their speakers are rows (source_file, speaker).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.metadata import field, is_kind
from nodeloom.functions.text import named, slug, strip
from nodeloom.operators.order import last_of_key


def lookup(files: DataFrame, entries: DataFrame) -> DataFrame:
    """files (source_file, fingerprint) with entry_file and matched_by: the entry of the fingerprint, else of the path.

    The last of several entries with one key counts: by ``ord`` if there is one, else by path and fingerprint. Two joins by one
    key each, not one by either.
    """
    entries = entries.withColumn("_ord", F.col("ord") if "ord" in entries.columns else F.struct("source_file", "source_fingerprint"))
    by_print = last_of_key(entries, "source_fingerprint", "_ord").select(F.col("source_fingerprint").alias("fingerprint"), F.col("source_file").alias("_by_print"))
    by_file = last_of_key(entries, "source_file", "_ord").select("source_file", F.col("source_file").alias("_by_file"))
    rows = files.join(by_print, "fingerprint", "left").join(by_file, "source_file", "left")
    matched = F.when(F.col("_by_print").isNotNull(), "fingerprint").when(F.col("_by_file").isNotNull(), "source_file")
    return rows.withColumns({"entry_file": F.coalesce("_by_print", "_by_file"), "matched_by": matched}).drop("_by_print", "_by_file")


def skip_decision(files: DataFrame, entries: DataFrame, entry_speakers: DataFrame, effective: DataFrame) -> DataFrame:
    """(source_file, decision, skip): why a file is imported or skipped in update mode.

    Without an entry it is imported; with no effective speaker skipped; else skipped only if the entry
    has all its effective speakers.
    """
    found = lookup(files, entries).select("source_file", "entry_file")
    have = entry_speakers.select(F.col("source_file").alias("entry_file"), "speaker").distinct().withColumn("_has", F.lit(True))
    rows = found.join(effective.select("source_file", "speaker"), "source_file", "left").join(have, ["entry_file", "speaker"], "left")
    sums = rows.groupBy("source_file").agg(F.max("entry_file").alias("entry_file"), F.count("speaker").alias("wanted"), F.count("_has").alias("had"))
    why = F.when(F.col("entry_file").isNull(), "no_entry").when(F.col("wanted") == 0, "none_selected").when(F.col("wanted") == F.col("had"), "covered").otherwise("new_speaker")
    return sums.select("source_file", why.alias("decision")).withColumn("skip", F.col("decision").isin("covered", "none_selected"))


def badges(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_file, badge): imported if the fingerprint is known, changed if only the path is, else empty."""
    badge = F.when(F.col("matched_by") == "fingerprint", "[imported]").when(F.col("matched_by") == "source_file", "[changed]").otherwise("")
    return lookup(files, entries).select("source_file", badge.alias("badge"))


def entries_of(selected: DataFrame, episodes: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of the files in ``episodes``, with the count of their selected nodes."""
    counts = selected.groupBy("source_file").agg(F.count("*").alias("n"))
    rows = episodes.join(files.select("source_file", F.col("fingerprint").alias("source_fingerprint")), "source_file").join(counts, "source_file", "left")
    return rows.select("source_file", "source_fingerprint", "episode_id", "episode_title", "episode_date", F.coalesce("n", F.lit(0)).cast("long").alias("document_count"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both by source_file: fields of the new one where both have one, counts added.

    Old entries without a source_file go; columns that only the old entries have are kept.
    """
    old = old.where(F.coalesce(F.col("source_file"), F.lit("")) != "")
    shared = [c for c in new.columns if c not in ("source_file", "document_count")]
    extra = [c for c in old.columns if c not in new.columns]
    a, b = old.alias("a"), new.alias("b")
    rows = a.join(b, "source_file", "full")
    pick = [F.when(F.col("b.document_count").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}") if c in old.columns else F.lit(None)).alias(c) for c in shared]
    count = F.coalesce(F.col("a.document_count").try_cast("long"), F.lit(0)) + F.coalesce(F.col("b.document_count").cast("long"), F.lit(0))
    return rows.select("source_file", *pick, count.alias("document_count"), *[F.col(f"a.{c}") for c in extra])


def merged_speakers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct (source_file, speaker_id, speaker) of both, ids made from the names."""
    rows = old.select("source_file", "speaker").union(new.select("source_file", "speaker")).where("speaker <> ''").distinct()
    return rows.withColumn("speaker_id", slug(F.col("speaker")))


def tolerant_names(speakers: Column) -> Column:
    """The names in a VARIANT list whose items are objects with a name, or scalars; stripped, none empty."""
    items = F.try_variant_get(speakers, "$", "array<variant>")
    names = F.transform(items, lambda x: strip(F.when(is_kind(x, "OBJECT"), field(x, "name").cast("string")).otherwise(x.cast("string"))))
    return F.filter(names, lambda x: x != "")


def header(entries: DataFrame, speakers: DataFrame, about: dict[str, str] | None = None) -> DataFrame:
    """One row: what ``about`` says (name, model, description and so on), episodes, chunks, speakers and the range of dates."""
    date = F.nullif(F.col("episode_date"), F.lit(""))
    totals = entries.agg(
        F.count("*").alias("episode_count"),
        F.coalesce(F.sum(F.coalesce(F.col("document_count").try_cast("long"), F.lit(0))), F.lit(0)).alias("chunk_count"),
        F.coalesce(F.min(date), F.lit("")).alias("start_date"),
        F.coalesce(F.max(date), F.lit("")).alias("end_date"),
    )
    rows = totals.crossJoin(speakers.agg(F.count_distinct("speaker").alias("speaker_count")))  # one row each
    return rows.select(*(F.lit(v).alias(k) for k, v in (about or {}).items()), *rows.columns)


def speaker_structs(names: Column) -> Column:
    """Sorted (id, name) structs of an array of names."""
    return F.transform(F.array_sort(F.array_distinct(names)), named)
