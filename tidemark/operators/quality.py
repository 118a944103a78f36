"""Outlier screening and cleaning of gauge series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.series import difference_of_observed


def robust_z(x, median, mad) -> F.Column:
    """Distance from the median in robust standard deviations."""
    return F.abs(x - median) / (1.4826 * mad)


def _with_mad(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    centred = df.withColumn("_med", F.median(column).over(w))
    return centred.withColumn("_mad", F.median(F.abs(F.col(column) - F.col("_med"))).over(w))


def outliers(obs: DataFrame, keys: Sequence[str] = ("entity", "station"), value: str = "value", z_change: float = 6.0, z_level: float = 5.0, min_diffs: int = 10) -> DataFrame:
    """Months whose level is out of line *and* next to a jump.

    Stage one takes changes between observed months whose robust z is above
    ``z_change``, and flags that month and the calendar month before it if it
    was observed.  Stage two keeps those whose level, against all observed
    levels, is above ``z_level``.  A key with few changes or a MAD of 0 has none.
    """
    keys = list(keys)
    seen = obs.filter(F.col(value).isNotNull())
    changes = _with_mad(difference_of_observed(seen, value, keys).withColumn("_k", F.count("change").over(Window.partitionBy(*keys))), "change", keys)
    jumps = changes.filter((F.col("_k") >= min_diffs) & (F.col("_mad") > 0)).filter(robust_z(F.col("change"), F.col("_med"), F.col("_mad")) > z_change)
    flagged = jumps.select(*keys, F.explode(F.array("month", F.add_months("month", -1))).alias("month")).distinct()
    levels = _with_mad(seen, value, keys).filter("_mad > 0").filter(robust_z(F.col(value), F.col("_med"), F.col("_mad")) > z_level)
    return levels.join(flagged, [*keys, "month"], "left_semi").select(*keys, "month", value)


def blank(obs: DataFrame, flags: DataFrame, keys: Sequence[str] = ("entity", "station"), value: str = "value") -> DataFrame:
    """Null the flagged cells; rows stay."""
    marked = flags.select(*keys, "month", F.lit(True).alias("_flag"))
    joined = obs.join(marked, [*keys, "month"], "left")
    return joined.withColumn(value, F.when(F.col("_flag").isNull(), F.col(value))).drop("_flag")


def availability(df: DataFrame, column: str, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Months, observed and missing ones, coverage in %, sample sd, quartile range and range."""
    n, seen = F.count("*"), F.count(column)
    return df.groupBy(*keys).agg(
        n.alias("n_months"),
        seen.alias("n_observed"),
        (n - seen).alias("n_missing"),
        (100 * seen / n).alias("coverage_pct"),
        F.stddev_samp(column).alias("sd"),
        (F.percentile(column, 0.75) - F.percentile(column, 0.25)).alias("iqr"),
        (F.max(column) - F.min(column)).alias("range"),
    )


def box_stats(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Median, quartiles, whiskers within 1.5 quartile ranges and the number of fliers."""
    quart = df.filter(F.col(column).isNotNull()).select(
        *keys, column, *[F.percentile(column, q).over(Window.partitionBy(*keys)).alias(name) for name, q in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))]
    )
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(low, high)
    return quart.groupBy(*keys).agg(
        F.max("q1").alias("q1"),
        F.max("med").alias("med"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col(column))).alias("whisker_low"),
        F.max(F.when(inside, F.col(column))).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"),
    )
