"""Ordered-series operators: calendars, shifts, rolling windows and gaps.

All of them are window expressions over ``partitionBy(keys).orderBy(t)``, so a
panel is shuffled once by its keys however many are combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Keys = Sequence[str]


def over(keys: Keys, order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def month_range(df: DataFrame, keys: Keys = (), time: str = "month") -> DataFrame:
    """Every month from the first to the last, by key or for the whole table."""
    span = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_z")).filter("_a is not null")
    return span.select(*keys, F.explode(F.sequence("_a", "_z", F.expr("interval 1 month"))).alias(time))


def complete_calendar(df: DataFrame, keys: Keys = ("entity",), time: str = "month", common: bool = False) -> DataFrame:
    """Reindex every key to a full calendar, its own or (``common``) that of all keys."""
    if common:
        grid = df.select(*keys).distinct().crossJoin(F.broadcast(month_range(df, (), time)))
    else:
        grid = month_range(df, keys, time)
    return grid.join(df, [*keys, time], "left")


def fixed_calendar(df: DataFrame, first: str, last: str, keys: Keys = ("entity",), time: str = "month") -> DataFrame:
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    return df.select(*keys).distinct().withColumn(time, months).join(df, [*keys, time], "left")


def with_position(df: DataFrame, keys: Keys = ("entity",), time: str = "month", name: str = "t") -> DataFrame:
    """1-based position by time and ``n``, the rows of the key."""
    return df.withColumns({name: F.row_number().over(over(keys, time)), "n": F.count("*").over(Window.partitionBy(*keys)).cast("int")})


def month_offset(df: DataFrame, keys: Keys = ("entity",), time: str = "month", name: str = "offset") -> DataFrame:
    index = F.year(time) * 12 + F.month(time)
    return df.withColumn(name, index - F.min(index).over(Window.partitionBy(*keys)) + 1)


def shift(column: str | Column, n: int, w: WindowSpec) -> Column:
    """Value ``n`` rows earlier; a negative ``n`` looks ahead."""
    return F.lag(column, n).over(w) if n >= 0 else F.lead(column, -n).over(w)


def rolling(aggregate, column: str | Column, n: int, w: WindowSpec) -> Column:
    """``aggregate`` of the last ``n`` rows, null unless all of them are known."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, aggregate(column).over(frame))


def forward_fill(column: str, limit: int, w: WindowSpec) -> Column:
    """The last known value, at most ``limit`` rows back; longer gaps are filled in part."""
    return F.last(column, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def difference_of_observed(df: DataFrame, column: str, keys: Keys, time: str = "month") -> DataFrame:
    """Change since the previous *observed* row, which may be months before."""
    seen = df.filter(F.col(column).isNotNull())
    return seen.withColumn("change", F.col(column) - F.lag(column).over(over(keys, time)))


def null_runs(df: DataFrame, column: str, keys: Keys = ("entity",), time: str = "month") -> DataFrame:
    """One row a run of nulls on the complete calendar: first, last, length."""
    placed = df.withColumn("_t", F.row_number().over(over(keys, time))).filter(F.col(column).isNull())
    island = placed.withColumn("_island", F.col("_t") - F.row_number().over(over(keys, "_t")))
    return island.groupBy(*keys, "_island").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("length")).drop("_island")


def longest_gap(df: DataFrame, column: str, keys: Keys = ("entity",), time: str = "month") -> DataFrame:
    """Longest run of nulls of every key; 0 without any."""
    longest = null_runs(df, column, keys, time).groupBy(*keys).agg(F.max("length").alias("longest_gap"))
    return df.select(*keys).distinct().join(longest, list(keys), "left").withColumn("longest_gap", F.coalesce("longest_gap", F.lit(0)).cast("long"))


def gap_spans(df: DataFrame, column: str, keys: Keys = ("entity",), time: str = "month", least: int = 2) -> DataFrame:
    """Runs of ``least`` nulls or more: (start, end) with end the first month known again, or the run's last."""
    runs = null_runs(df, column, keys, time).filter(F.col("length") >= least)
    last = df.groupBy(*keys).agg(F.max(time).alias("_end"))
    end = F.when(F.col("last") < F.col("_end"), F.add_months("last", 1)).otherwise(F.col("last"))
    return runs.join(last, list(keys)).select(*keys, F.col("first").alias("start"), end.alias("end"), "length")


def fill_gaps(df: DataFrame, column: str, limit: int, keys: Keys = ("entity",), time: str = "month") -> DataFrame:
    """Linear interpolation of inner runs up to ``limit``; runs at an edge take the nearest value; longer runs stay."""
    w = over(keys, time)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    placed = df.withColumn("_t", F.row_number().over(w))
    at = F.when(F.col(column).isNotNull(), F.col("_t"))
    known = placed.withColumns(
        {
            "_x0": F.last(column, True).over(before),
            "_x1": F.first(column, True).over(after),
            "_t0": F.last(at, True).over(before),
            "_t1": F.first(at, True).over(after),
            "_n": F.count("*").over(Window.partitionBy(*keys)),
        }
    )
    run = F.coalesce("_t1", F.col("_n") + 1) - F.coalesce("_t0", F.lit(0)) - 1
    between = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("_t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    filled = F.when(F.col(column).isNotNull(), F.col(column)).when(run <= limit, F.coalesce(between, "_x0", "_x1"))
    return known.withColumn(column, filled).drop("_t", "_x0", "_x1", "_t0", "_t1", "_n")


def expanding_folds(df: DataFrame, k: int = 3, keys: Keys = ("entity",)) -> DataFrame:
    """``(fold, train_end, val_end)`` by key: half of the rows train the first fold; no folds of fewer than five rows."""
    half = F.floor(F.col("n") / 2)
    size = F.floor((F.col("n") - half) / (k + 1))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumns({"half": half, "size": size}).filter("size >= 5")
    folds = counts.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    end = F.col("half") + F.col("size") * (F.col("fold") - 1)
    return folds.select(*keys, "fold", end.cast("long").alias("train_end"), (end + F.col("size")).cast("long").alias("val_end"))
