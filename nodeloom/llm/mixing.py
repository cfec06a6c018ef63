"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a target of tokens. Among all document rates that meet the targets and do not exceed
``MOST`` copies, those nearest to one copy of everything (in relative entropy) are exponentially tilted by
the document's size: rate = min(MOST, exp(lambda * size / scale)), with one lambda per source. The lambdas
maximise the convex dual; distributed Newton steps, kept inside a bracket, find them. Rates become
whole copies by a threshold on rate plus a hash-based offset, placed per source so that the copies' tokens
come as near to the target as whole documents allow.

Sums are over integers, so the result does not depend on the order of rows, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import BROADCAST_ROWS, stored

#: Weights of the sources in order, repeating; share of all tokens to take; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Steps between two scratch tables; they end once every source is met to TOLERANCE. Ends of a bracket that is not found yet.
STEPS, TOLERANCE, FAR = 4, 1e-6, 1e18
#: Rates and offsets are whole numbers of 1 / UNIT; levels of 2**LEVEL_BITS thresholds each place the cut.
UNIT, LEVEL_BITS, LEVELS = 1 << 40, 11, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn. The targets are weight * level, at most
    ``most`` times the source's size, with the level at which they sum to share of all tokens (no more than
    all caps together).
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("left", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("at", F.row_number().over(filled)).withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    # the level if all sources before this one are full; right for the first source that it does not fill
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("at", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(first * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def _joined(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """rows with the state of their source; the state is broadcast only if it was counted to be small."""
    state = state.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(state) if small else state, rows["source"].eqNullSafe(state["_s"])).drop("_s")


def _rate(most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("tilt") * F.col("size") / F.col("scale"))))


def _exact(column: Column) -> Column:
    """A sum that does not depend on the order of rows: of 2**-16ths, as whole numbers."""
    return F.sum(F.round(column * 65536).cast("decimal(38,0)")).cast("double") / 65536


def tilts(cells: DataFrame, targets: DataFrame, small: bool, most: int = MOST) -> DataFrame:
    """(source, source_size, target, scale, tilt) of the sources whose target is below their cap.

    cells are (source, size, docs): documents of one size share a rate, so Newton steps run on them.
    """
    scales = cells.groupBy("source").agg(F.max("size").cast("double").alias("scale"))
    state = _joined(targets.where(f"source_size > 0 and target < {most} * source_size"), scales, small)
    state = stored(state.withColumns({"tilt": F.lit(0.0), "low": F.lit(-FAR), "high": F.lit(FAR), "miss": F.lit(FAR)}), "tilts")
    while True:
        for _ in range(STEPS):
            rows = _joined(cells, state.select("source", "scale", "tilt"), small).withColumn("rate", _rate(most))
            tokens = F.col("docs") * F.col("size") * F.col("rate")
            slope = F.when(F.col("rate") < most, tokens * F.col("size") / F.col("scale")).otherwise(0.0)
            sums = rows.groupBy("source").agg(_exact(tokens).alias("tokens"), _exact(slope).alias("slope"))
            state = _joined(state, sums, small).withColumnRenamed("miss", "was")
            off = F.col("tokens") - F.col("target")
            state = state.withColumns({"low": F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(off > 0, F.col("tilt")).otherwise(F.col("high")), "miss": F.abs(off) / F.col("target")})
            step = F.col("tilt") - F.col("tokens") / F.col("slope") + F.col("target") / F.col("slope")
            # Newton's step while it stays in the bracket and gains; else half the bracket, or farther out while it has one end only
            newton = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")) & (F.col("miss") <= F.col("was") / 2)
            out = F.when(F.col("high") == FAR, F.abs("tilt") + 1).when(F.col("low") == -FAR, -F.abs("tilt") - 1)
            tilt = F.when(F.col("miss") <= TOLERANCE, F.col("tilt")).when(newton, step).otherwise(F.coalesce(F.col("tilt") + out, (F.col("low") + F.col("high")) / 2))
            state = state.withColumn("tilt", tilt).drop("tokens", "slope", "was")
        state = stored(state, "tilts")
        # a bracket without room for another number ends its source: no tilt meets the target better
        if state.where((F.col("miss") > TOLERANCE) & (F.col("high") - F.col("low") > 1e-12 * (1 + F.abs("tilt")))).isEmpty():
            break
    return state.select("source", "source_size", "target", "scale", "tilt")


def _level(most: int, salt: Column) -> Column:
    """rate + offset of a document in UNITs: copy k is taken if k * UNIT - this is at most the source's cut."""
    return (_rate(most) * UNIT).cast("long") + F.pmod(F.xxhash64(salt, F.lit(20240511)), F.lit(UNIT))


def cuts(sizes: DataFrame, state: DataFrame, small: bool, most: int = MOST) -> DataFrame:
    """state plus ``cut``: the threshold of each source at which its copies come nearest to its target.

    A weighted order statistic, found by histograms that are refined level by level.
    """
    bits = LEVEL_BITS * LEVELS
    state = state.withColumns({"part": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
    for level in range(LEVELS):
        shift = bits - LEVEL_BITS * (level + 1)
        rows = _joined(sizes.where("size > 0"), state, small).withColumn("level", _level(most, F.col("doc_id")))
        rows = rows.select("source", "size", "part", F.explode(F.array(*(F.lit((k + most) * UNIT) - F.col("level") for k in range(1, most + 1)))).alias("t"))
        if level:
            rows = rows.where(F.shiftright("t", shift + LEVEL_BITS) == F.col("part"))
        bins = rows.groupBy("source", F.shiftright("t", shift).alias("bin")).agg(F.sum("size").alias("tokens"))
        bins = _joined(bins, state.select("source", "target", "below"), small)
        order = Window.partitionBy("source").orderBy("bin")  # at most 2**LEVEL_BITS rows a source
        bins = bins.withColumn("upto", F.col("below") + F.sum("tokens").over(order))
        picked = bins.where("upto >= target").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("below"), "upto")).alias("p"))
        state = _joined(state.drop("part", "below"), picked.select("source", F.col("p.bin").alias("part"), F.col("p.below").alias("below"), F.col("p.upto").alias("upto")), small)
        state = stored(state if level == LEVELS - 1 else state.drop("upto"), "cuts")
    near = F.col("upto") - F.col("target") <= F.col("target") - F.col("below")
    cut = F.when(near, F.col("part")).otherwise(F.col("part") - 1) - most * UNIT
    return state.select("source", "source_size", "target", "scale", "tilt", cut.alias("cut"))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, scale, tilt, cut) per source, from rows (doc_id, source, size)."""
    cells = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("docs")), "cells")
    totals = cells.select("source", (F.col("size") * F.col("docs")).alias("size"))
    targets = stored(source_targets(totals, weights, share, most), "targets")
    small = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = cuts(sizes, tilts(cells, targets, small, most), small, most)
    rest = targets.join(found.select(F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
    blank = {"scale": F.lit(None).cast("double"), "tilt": F.lit(None).cast("double"), "cut": F.lit(None).cast("long")}
    return stored(found.unionByName(rest.withColumns(blank)), "plan")


def with_copies(rows: DataFrame, plan: DataFrame, most: int = MOST) -> DataFrame:
    """rows (doc_id, source, size, ...) plus source_size, target and copies (0 to most)."""
    small = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = _joined(rows, plan, small)
    by_cut = F.floor((F.col("cut") + _level(most, F.col("doc_id"))) / UNIT)
    copies = F.when(F.col("cut").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(most), by_cut))).when(F.col("source_size") > 0, most).otherwise(1)
    return out.withColumn("copies", copies.cast("int")).drop("scale", "tilt", "cut")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs(doc_id, text, source).

    size is the number of words; null and empty texts have size 0 and take nothing. A null source is a source
    of its own. Rows that share an id are separate documents of one offset (equal rows are taken alike); a
    null id has an offset as any other. A source without words has target 0. An empty table gives an empty
    result; other columns are ignored.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out = with_copies(sizes, mixing_plan(sizes, weights, share, most), most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (not at all, once, or more).

    Rows without words (null and empty texts) stay once if their source has no words at all, and else as often as its cut says
    (they take nothing either way). Null ids and sources and repeated rows are as in ``mix``; all columns pass
    unchanged, whatever their names; an empty table stays empty.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = stored(rows.drop("row"), "sizes")
    rows = with_copies(rows, mixing_plan(sizes, **options)).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
