"""Ranks and running figures over whole families, dealt by ranges of values instead of sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.lineage import cut


def family_key(family: Sequence[str]) -> F.Column:
    """One text that tells families apart, null members included."""
    return F.to_json(F.struct(*family)) if family else F.lit("")


def ranged(df: DataFrame, order: str) -> DataFrame:
    """Rows with the number ``_range`` of their range of ``(_family, order)``, stored so that a lost task finds the same ranges."""
    return cut(df.repartitionByRange("_family", order).withColumn("_range", F.spark_partition_id()))


def running(spread: DataFrame, order: str, value: F.Column, out: str, lowest: bool = False) -> DataFrame:
    """Sum of ``value`` up to and with a row of ``ranged``, or with ``lowest`` its minimum from the row on.

    A window sums within a range; the ranges before (or after) add one figure
    each, so only a table of a row a family and range is ordered as a whole.
    """
    fold = F.min if lowest else F.sum
    by_range, by_order = (F.col("_range").desc(), F.col(order).desc()) if lowest else (F.col("_range"), F.col(order))
    unbounded = Window.unboundedPreceding
    parts = spread.groupBy("_family", "_range").agg(fold(value).alias("_part"))
    earlier = Window.partitionBy("_family").orderBy(by_range).rowsBetween(unbounded, -1)
    offsets = parts.select("_family", "_range", fold("_part").over(earlier).alias("_offset"))
    here = fold(value).over(Window.partitionBy("_family", "_range").orderBy(by_order).rowsBetween(unbounded, 0))
    whole = F.least(here, "_offset") if lowest else here + F.coalesce("_offset", F.lit(0))
    return spread.join(offsets, ["_family", "_range"]).withColumn(out, whole).drop("_offset")


def tie_ranks(counts: DataFrame, value: str, n: str, out: str = "rank") -> DataFrame:
    """Average rank of every distinct ``value`` of a ``_family`` that ``n`` rows have."""
    upto = running(ranged(counts, value), value, F.col(n), "_upto")
    return upto.withColumn(out, F.col("_upto") - (F.col(n) - 1) / 2).drop("_upto", "_range")


def average_rank(df: DataFrame, value: str, family: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Rows with the average rank of their value in the family; null values have none.

    The rows are stored first, so that a value is the same where it is ranked and where it is looked up.
    """
    keyed = cut(df.withColumn("_family", family_key(family)))
    counts = keyed.filter(F.col(value).isNotNull()).groupBy("_family", value).agg(F.count("*").alias("_n"))
    return keyed.join(tie_ranks(counts, value, "_n", out).drop("_n"), ["_family", value], "left").select(*df.columns, out)
