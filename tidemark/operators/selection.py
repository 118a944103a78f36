"""Predictor selection from edges, lags and ordinary least squares."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import kernels as K


def retained(edges: DataFrame) -> DataFrame:
    """Edges with evidence and a known lag of 0 or more."""
    return edges.filter("causal_evidence and obs_lag is not null and obs_lag >= 0").withColumn("lag", F.col("obs_lag").cast("int"))


def reselect(chosen: DataFrame, forecast: DataFrame, keys: Sequence[str] = ("entity", "variable")) -> DataFrame:
    """Lags below 1 replaced by the best one a forecast may use; dropped where there is none."""
    new = forecast.select(*keys, F.col("lag").alias("_new"))
    joined = chosen.withColumnRenamed("lag", "old_lag").join(new, list(keys), "left")
    return joined.withColumn("lag", F.when(F.col("old_lag") >= 1, F.col("old_lag")).otherwise(F.col("_new"))).filter("lag is not null").drop("_new")


def first_step(panel: DataFrame, target: str, variables: Sequence[str], key: str = "entity", least: int = 20) -> DataFrame:
    """The first variable of a forward selection by AIC, from moments alone; keys that none improves have no row."""
    full = panel.na.drop(subset=[target, *variables])
    long = full.unpivot([key, target], list(variables), "variable", "x")
    m = long.groupBy(key, "variable").agg(F.count("*").alias("n"), F.var_pop(target).alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("x", target).alias("c")).filter((F.col("n") >= least) & (F.col("vx") > 0))
    ssr = F.col("n") * (F.col("vy") - F.col("c") * F.col("c") / F.col("vx"))
    base = F.col("n") * F.log(2 * math.pi * F.col("vy")) + F.col("n") + 2
    aic = F.col("n") * F.log(2 * math.pi * ssr / F.col("n")) + F.col("n") + 4
    better = m.withColumns({"aic": aic, "base": base}).filter("aic < base")
    best = better.groupBy(key).agg(F.min(F.struct("aic", "variable")).alias("b"))
    return best.select(key, F.col("b.variable").alias("variable"), F.col("b.aic").alias("aic"))


def stepwise(panel: DataFrame, target: str, variables: Sequence[str], key: str = "entity", criterion: str = "aic", least: int = 20) -> DataFrame:
    """``(entity, step, variable)`` of a whole forward selection: one numpy fit a key, candidates in the order given."""

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        chosen = K.stepwise(group[target].to_numpy(float), group[list(variables)].to_numpy(float), list(variables), criterion, least)
        return pd.DataFrame({key: keys[0], "step": range(1, len(chosen) + 1), "variable": chosen})

    return panel.select(key, target, *variables).groupBy(key).applyInPandas(run, f"{key} string, step int, variable string")


def stepwise_lags(panel: DataFrame, lags: DataFrame, target: str, key: str = "entity", criterion: str = "aic") -> DataFrame:
    """The lags of ``lags(entity, variable, lag)`` whose shifted variables a forward selection keeps, by entity."""
    variables = sorted(r[0] for r in lags.select("variable").distinct().collect())  # the panel's columns
    by = F.create_map(*[x for v in variables for x in (F.lit(v), F.col(v))])
    moved = panel.select(key, "t", F.explode(by).alias("variable", "x")).join(lags.select(key, "variable", "lag"), [key, "variable"]).withColumn("t", F.col("t") + F.col("lag"))
    wide = panel.select(key, "t", target).join(moved.groupBy(key, "t").pivot("variable", variables).agg(F.first("x")).drop(target), [key, "t"], "left")
    # A variable without a lag for an entity has no values there; 0 keeps the rows complete and adds nothing to a fit.
    have = lags.groupBy(key).agg(F.collect_set("variable").alias("_have"))
    wide = wide.join(F.broadcast(have), key)
    wide = wide.withColumns({v: F.when(F.array_contains("_have", v), F.col(v)).otherwise(F.lit(0.0)) for v in variables})
    kept = stepwise(wide, target, variables, key, criterion)
    return kept.join(lags.select(key, "variable", "lag"), [key, "variable"])
