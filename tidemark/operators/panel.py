"""Panels: combining gauges, aligning variables, removing the season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.series import month_range, with_position


def combine_stations(clean: DataFrame, entity: str = "entity", station: str = "station", value: str = "value") -> DataFrame:
    """Entity level: mean of the available centred gauges plus the mean of the gauges' means."""
    mean = F.avg(value).over(Window.partitionBy(entity, station))
    centred = clean.withColumn("_m", mean).withColumn("_c", F.col(value) - F.col("_m"))
    base = clean.groupBy(entity, station).agg(F.avg(value).alias("_m")).groupBy(entity).agg(F.avg("_m").alias("_base"))
    return centred.groupBy(entity, "month").agg(F.avg("_c").alias("_c")).join(F.broadcast(base), entity).select(entity, "month", (F.col("_c") + F.col("_base")).alias("wl"))


def regulated_sum(obs: DataFrame, entity: str = "entity", station: str = "station", value: str = "value", years: tuple[int, int] | None = None) -> DataFrame:
    """Sum of all fetched gauges of a month: null if one of them is null, and outside ``years``."""
    fetched = obs.filter(F.col(value).isNotNull()).groupBy(entity).agg(F.countDistinct(station).alias("_n"))
    total = obs.groupBy(entity, "month").agg(F.sum(value).alias("_sum"), F.count(value).alias("_k")).join(F.broadcast(fetched), entity)
    kept = F.when(F.col("_k") == F.col("_n"), F.col("_sum"))
    if years:
        kept = F.when(F.year("month").between(*years), kept)
    return total.select(entity, "month", kept.alias("flow"))


def align(parts: Sequence[DataFrame], entity: str = "entity") -> DataFrame:
    """Join series tables on (entity, month) over the full common calendar, with position ``t`` and ``n``."""
    months = parts[0].select("month")
    for p in parts[1:]:
        months = months.unionByName(p.select("month"))
    panel = parts[0].select(entity).distinct().crossJoin(F.broadcast(month_range(months)))
    for p in parts:
        panel = panel.join(p, [entity, "month"], "left")
    return with_position(panel, (entity,))


def deseasonalise(panel: DataFrame, columns: Sequence[str], horizon: int, entity: str = "entity") -> DataFrame:
    """Subtract each calendar month's mean over the training rows (all but the last ``horizon``) from all rows."""
    season = Window.partitionBy(entity, F.month("month"))
    training = F.col("t") <= F.col("n") - horizon
    return panel.withColumns({c: F.col(c) - F.avg(F.when(training, F.col(c))).over(season) for c in columns})


def centred(panel: DataFrame, column: str, entity: str = "entity") -> DataFrame:
    return panel.withColumn(column, F.col(column) - F.avg(column).over(Window.partitionBy(entity)))


def training_rows(panel: DataFrame, horizon: int) -> DataFrame:
    return panel.filter(F.col("t") <= F.col("n") - horizon)
