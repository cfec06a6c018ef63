"""Running totals and positions in a global order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.sources.shared import Scratch


def running_total(rows: DataFrame, keys: list[Column], value: Column, name: str) -> DataFrame:
    """rows plus ``name``: the sum of ``value`` over all rows up to this one in the order of ``keys``.

    The input is evaluated once, into a scratch table; from there rows go to ranges of the order, each stored as it was dealt. A range is a
    window partition of its own, and the totals of the ranges before it, one row a range, are joined to it. Rows with equal keys
    share a range and a total.
    """
    tables = Scratch(rows.sparkSession, "running-total")
    names = [f"_k{i}" for i in range(len(keys))]
    once = tables.store(rows.withColumns({**dict(zip(names, keys, strict=True)), "_value": value}), "rows")
    dealt = tables.store(once.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("_range").orderBy(*names)
    out = dealt.join(F.broadcast(before.select("_range", "_before")), "_range")
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.sum("_value").over(inside)).select(*rows.columns, name)


def positions(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """rows plus their position from 1 in the order of ``keys``."""
    return running_total(rows, keys, F.lit(1).cast("long"), name)


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """rows plus rn (position in the group from 1) and batch (from 0, of at most ``size`` rows)."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    place = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(place).cast("long")).withColumn("batch", F.floor((F.col("rn") - 1) / size))


def last_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key the last in ``order``; rows whose key is null or empty go."""
    rows = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")
