"""Lag features and lag selection by cross-correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import over, shift

STATE_NAMES = ("wl_lag1", "wl_lag2", "wl_lag3", "wl_lag6", "wl_lag12", "wl_diff1", "wl_diff3", "wl_mean3", "wl_mean6", "wl_std3")


def _before(aggregate, column: str, n: int, w, lag: int = 1):
    """``aggregate`` of the ``n`` rows that end ``lag`` rows earlier; null unless all are known."""
    frame = w.rowsBetween(-(lag + n - 1), -lag)
    return F.when(F.count(column).over(frame) == n, aggregate(column).over(frame))


def state_features(panel: DataFrame, column: str, lags: Sequence[int], keys: Sequence[str] = ("entity",), time: str = "t") -> DataFrame:
    """Own lags, two differences, means of three and six months and a three-month sd, all of the past."""
    w = over(keys, time)
    out = {f"wl_lag{k}": shift(column, k, w) for k in lags}
    out |= {"wl_diff1": shift(column, 1, w) - shift(column, 2, w), "wl_diff3": shift(column, 1, w) - shift(column, 4, w)}
    out |= {f"wl_mean{n}": _before(F.avg, column, n, w) for n in (3, 6)} | {"wl_std3": _before(F.stddev_samp, column, 3, w)}
    return panel.withColumns(out)


def exog_names(variable: str, windows: Sequence[int]) -> list[str]:
    return [f"{variable}_lag", *[f"{variable}_mean{n}" for n in windows]]


def exogenous_features(panel: DataFrame, lags: Mapping[str, int], windows: Sequence[int], keys: Sequence[str] = ("entity",), time: str = "t") -> DataFrame:
    """For each variable its value ``lag`` months ago, and means over windows that end then."""
    w = over(keys, time)
    out = {}
    for v, k in lags.items():
        out[f"{v}_lag"] = shift(v, k, w)
        out |= {f"{v}_mean{n}": _before(F.avg, v, n, w, k) for n in windows}
    return panel.withColumns(out)


def cross_correlations(panel: DataFrame, target: str, variables: Sequence[str], lags: Sequence[int], key: str = "entity", least: int = 20) -> DataFrame:
    """Pearson r of the target with each variable ``lag`` months before; constant or short pairs are left out."""
    long = panel.unpivot([key, "t"], list(variables), "variable", "x").filter("x is not null")
    lagged = long.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("t", F.col("t") + F.col("lag"))
    pairs = lagged.join(panel.select(key, "t", F.col(target).alias("y")).filter("y is not null"), [key, "t"])
    stats = pairs.groupBy(key, "variable", "lag").agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")
    )
    return stats.filter((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)).select(key, "variable", "lag", "n", (F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))


def best_cross_correlation(panel: DataFrame, target: str, variables: Sequence[str], lags: Sequence[int], key: str = "entity") -> DataFrame:
    """The lag with the largest \\|r\\|, the shorter of equals."""
    r = cross_correlations(panel, target, variables, lags, key)
    best = r.groupBy(key, "variable").agg(F.min(F.struct((-F.abs("r")).alias("a"), "lag", "r")).alias("b"))
    return best.select(key, "variable", F.col("b.lag").alias("lag"), F.col("b.r").alias("r"))
