"""Rolling-origin forecasts that need no fitted model, and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _origins(panel: DataFrame, column: str, horizons: Sequence[int], window: int, key: str) -> DataFrame:
    start = panel.filter(F.col("t") >= F.col("n") - window).select(key, F.col("t").alias("t0"), F.col(column).alias("_last"))
    return start.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))


def rolling_persistence(panel: DataFrame, column: str, horizons: Sequence[int], window: int, key: str = "entity") -> DataFrame:
    """The last value carried to every horizon; origins without a value are skipped, null actuals stay."""
    ahead = _origins(panel, column, horizons, window, key).withColumn("t", F.col("t0") + F.col("h"))
    actual = panel.select(key, "t", F.col(column).alias("actual"))
    return ahead.filter("_last is not null").join(actual, [key, "t"]).select(key, "h", "t0", "actual", F.col("_last").alias("pred"))


def rolling_seasonal(panel: DataFrame, column: str, horizons: Sequence[int], window: int, period: int = 12, key: str = "entity") -> DataFrame:
    """The value a period before the target month."""
    ahead = _origins(panel, column, horizons, window, key).withColumn("t", F.col("t0") + F.col("h"))
    past = panel.select(key, (F.col("t") + period).alias("t"), F.col(column).alias("pred")).filter("pred is not null")
    actual = panel.select(key, "t", F.col(column).alias("actual"))
    return ahead.join(actual, [key, "t"]).join(past, [key, "t"]).select(key, "h", "t0", "actual", "pred")


def persistence(panel: DataFrame, column: str, horizon: int, key: str = "entity") -> DataFrame:
    """The last training value for every test month; an unknown one predicts nothing."""
    last = panel.filter(F.col("t") == F.col("n") - horizon).select(key, F.col(column).alias("pred"))
    return panel.filter(F.col("t") > F.col("n") - horizon).select(key, "t", F.col(column).alias("actual")).join(last, key, "left")


def align(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("entity", "h"), origin: str = "t0", least: int = 10) -> DataFrame:
    """Predictions of two methods on their common origins; groups with fewer than ``least`` are dropped."""
    on = [*keys, origin]
    both = first.select(*on, "actual", F.col("pred").alias("p1")).join(second.select(*on, F.col("pred").alias("p2")), on)
    enough = both.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return both.join(enough, list(keys))


def foresight(df: DataFrame, lag: str, horizon: int) -> DataFrame:
    """Test months a lag serves without foresight, their share, by the smallest lag of a method."""
    free = F.least(F.col(lag), F.lit(horizon))
    return df.withColumns({"free_months": free, "frac_free": free / horizon})


def matched(scores: DataFrame, entity: str, cells: Sequence[str]) -> DataFrame:
    """Rows of the entities that have every combination of ``cells`` (relational division)."""
    n_cells = scores.select(*cells).distinct().agg(F.count("*").alias("_all"))
    full = scores.groupBy(entity).agg(F.countDistinct(*cells).alias("_n")).join(F.broadcast(n_cells), F.col("_n") == F.col("_all")).select(entity)
    return scores.join(full, entity, "left_semi")


def compare(predictions: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("entity", "h"), origin: str = "t0", least: int = 10) -> DataFrame:
    """``predictions(method, ...)`` of both methods of each predeclared pair ``(method_1, method_2)`` on their common origins.

    A pair of which a method has no predictions has no rows; a group with fewer
    than ``least`` complete origins is dropped.
    """
    known = predictions.filter("actual is not null and pred is not null")
    on = [*keys, origin]
    first = known.select(F.col("method").alias("method_1"), *on, "actual", F.col("pred").alias("p1")).join(F.broadcast(pairs), "method_1")
    second = known.select(F.col("method").alias("method_2"), *on, F.col("pred").alias("p2"))
    both = first.join(second, ["method_2", *on])
    enough = both.groupBy("method_1", "method_2", *keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return both.join(enough, ["method_1", "method_2", *keys])
