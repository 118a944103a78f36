"""Queries of numerical kernels, which no SQL expresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DRIVER
from tidemark.operators import features as X
from tidemark.operators import models as M
from tidemark.operators import selection as Sel
from tidemark.operators import stats as S
from tidemark.queries.base import Query
from tidemark.queries.panels import anomaly, stored_anomaly
from tidemark.sources import tables as T

GRID = (2, 0.1, 40)


def _iaaft(spark, sf):
    return M.surrogates(anomaly(spark, sf).withColumn("t", F.col("t").cast("int")), "P", DRIVER.n_surrogates)


def _edges(spark, sf):
    a = anomaly(spark, sf)
    long = a.unpivot(["entity", "t", "WL"], ["P", "RegFlow", "SWE"], "cause", "x").select("entity", "cause", F.lit("WL").alias("effect"), F.col("t").cast("int").alias("t"), "x", F.col("WL").alias("y"))
    return M.test_edges(long, 3, 1, DRIVER.lags, DRIVER.n_surrogates)


def _panel(spark, sf):
    """The whole calendar: a month without a level stays, so that a lag is a month."""
    return anomaly(spark, sf).withColumn("t", F.col("t").cast("int"))


LAGGED = {"P": 1, "Temp": 2}


def _lagged(spark, sf):
    """The panel with each driver's value and antecedent means at its lag; no month sees its own drivers."""
    return X.exogenous_features(_panel(spark, sf), LAGGED, DRIVER.antecedent_windows), [n for v in LAGGED for n in X.exog_names(v, DRIVER.antecedent_windows)]


def _boosted(spark, sf):
    panel, names = _lagged(spark, sf)
    f = M.boosted_forecast(panel, "WL", names, DRIVER.horizon, GRID)
    return S.error_metrics(f, ["entity"])


def _rolling_boosted(spark, sf):
    panel, names = _lagged(spark, sf)
    f = M.rolling_boosted(panel, "WL", names, DRIVER.rolling_horizons, 24, GRID)
    return S.error_metrics(f, ["entity", "h"])


def _tune(spark, sf):
    return M.tune(_panel(spark, sf), "WL", DRIVER.tuning_grid)


def _arima(spark, sf):
    f = M.arima_forecast(_panel(spark, sf), "WL", [], DRIVER.horizon)
    return S.error_metrics(f, ["entity"]).join(f.groupBy("entity").agg(F.max("model_order").alias("model_order"), F.max("status").alias("status")), "entity")


def _arimax(spark, sf):
    f = M.arima_forecast(_lagged(spark, sf)[0], "WL", [f"{v}_lag" for v in LAGGED], DRIVER.horizon)
    return S.error_metrics(f, ["entity"]).join(f.groupBy("entity").agg(F.max("model_order").alias("model_order"), F.max("status").alias("status")), "entity")


def _stepwise(spark, sf):
    """Every step of the selection among the drivers at their best lags, on the training months."""
    panel = stored_anomaly(spark, sf)
    lags = X.best_cross_correlation(panel, "WL", T.VARIABLES, DRIVER.forecast_lags)
    kept = Sel.stepwise_lags(panel.filter(F.col("t") <= F.col("n") - DRIVER.horizon), lags, "WL")
    return kept.select("entity", F.col("step").cast("long").alias("step"), "variable", F.col("lag").cast("long").alias("lag"))


def _rolling_arima(spark, sf):
    f = M.rolling_arima(_panel(spark, sf), "WL", DRIVER.rolling_horizons, 24)
    return S.error_metrics(f, ["entity", "h"])


QUERIES = {
    "iaaft_surrogate": Query(_iaaft, None),
    "full_edge_test": Query(_edges, None),
    "gbdt_recursive": Query(_boosted, None),
    "rolling_gbdt": Query(_rolling_boosted, None),
    "gbdt_tuning": Query(_tune, None),
    "stepwise_lags": Query(_stepwise, None),
    "sarima": Query(_arima, None),
    "sarimax": Query(_arimax, None),
    "rolling_sarima": Query(_rolling_arima, None),
}
