"""Edge tests and fitted forecasts over groups: one Arrow group a series.

A group is one entity's panel of some hundred months, so groups are small and
many; the work is spread by entity, edge, grid point or origin.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.operators.features import STATE_NAMES, state_features

EDGE = (
    "status string, obs_lag int, obs_rho double, obs_n int, p_value double, null_mean double, null_std double, n_valid int, "
    "converges boolean, kendall_tau double, kendall_p double"
)


def test_edges(series: DataFrame, dim: int, tau: int, lags: Sequence[int], n_surrogates: int, key: str = "entity", draws: int = 50) -> DataFrame:
    """One row an edge from ``series(entity, cause, effect, t, x, y)``: x the cause's values, y the effect's."""

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        entity, cause, effect = keys
        found = K.edge_test(group["x"].to_numpy(float), group["y"].to_numpy(float), dim, tau, tuple(lags), n_surrogates, K.seed(cause, effect), draws)
        return pd.DataFrame([{key: entity, "cause": cause, "effect": effect} | found]).astype({"obs_lag": "Int32", "obs_n": "Int32", "n_valid": "Int32", "converges": "boolean"})

    return series.groupBy(key, "cause", "effect").applyInPandas(run, f"{key} string, cause string, effect string, {EDGE}")


def surrogates(series: DataFrame, column: str, n: int, key: str = "entity") -> DataFrame:
    """IAAFT surrogates of the known values, each value where one was known."""

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        x = group[column].to_numpy(float)
        seen = ~np.isnan(x)
        rng = np.random.default_rng(K.seed(str(keys[0]), column))
        return pd.concat([pd.DataFrame({key: keys[0], "surrogate": r, "t": group["t"].to_numpy()[seen], "x": K.iaaft(x[seen], rng)}) for r in range(n)])

    return series.filter(F.col(column).isNotNull()).groupBy(key).applyInPandas(run, f"{key} string, surrogate int, t int, x double")


def _own_features(history: list[float]) -> list[float]:
    """The state features of the next month from the values so far (NaN where unknown)."""

    def back(k: int) -> float:
        return history[-k] if len(history) >= k else np.nan

    def mean(n: int) -> float:
        return float(np.mean(history[-n:])) if len(history) >= n else np.nan

    sd = float(np.std(history[-3:], ddof=1)) if len(history) >= 3 else np.nan
    return [*(back(k) for k in (1, 2, 3, 6, 12)), back(1) - back(2), back(1) - back(4), mean(3), mean(6), sd]


def _recursive(model: K.BoostedTrees, history: list[float], exog: np.ndarray) -> list[float]:
    """One prediction a row of ``exog``; a row with a gap predicts nothing and leaves a gap behind."""
    out = []
    for row in exog:
        features = np.array([*_own_features(history), *row])
        value = float(model.predict(features[None, :])[0]) if not np.isnan(features).any() else np.nan
        out.append(value)
        history.append(value)
    return out


def _training(group: pd.DataFrame, column: str, exog: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    x, y = group[[*STATE_NAMES, *exog]].to_numpy(float), group[column].to_numpy(float)
    full = ~(np.isnan(x).any(axis=1) | np.isnan(y))
    return x[full], y[full]


def boosted_forecast(panel: DataFrame, column: str, exog: Sequence[str], horizon: int, grid: tuple[int, float, int], key: str = "entity") -> DataFrame:
    """Recursive forecast of the last ``horizon`` rows from a model of the others."""
    depth, rate, trees = grid

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        train, test = group.iloc[:-horizon], group.iloc[-horizon:]
        x, y = _training(train, column, exog)
        if len(y) < 20:
            pred = [np.nan] * len(test)
        else:
            model = K.BoostedTrees(depth, rate, trees).fit(x, y)
            pred = _recursive(model, train[column].ffill(limit=6).tolist(), test[list(exog)].to_numpy(float))
        return pd.DataFrame({key: keys[0], "t": test["t"].to_numpy(), "actual": test[column].to_numpy(float), "pred": pred})

    return state_features(panel, column, (1, 2, 3, 6, 12)).groupBy(key).applyInPandas(run, f"{key} string, t int, actual double, pred double")


def rolling_boosted(panel: DataFrame, column: str, exog: Sequence[str], horizons: Sequence[int], window: int, grid: tuple[int, float, int], key: str = "entity") -> DataFrame:
    """From every origin of the last ``window`` rows; an origin ends at its first gap, earlier horizons stay."""
    depth, rate, trees = grid

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        n = len(group)
        x, y = _training(group.iloc[: n - window], column, exog)
        rows = []
        if len(y) >= 20:
            model = K.BoostedTrees(depth, rate, trees).fit(x, y)
            values, drivers = group[column].ffill(limit=6).tolist(), group[list(exog)].to_numpy(float)
            actual = group[column].to_numpy(float)
            for origin in range(n - window - 1, n - 1):
                ahead = drivers[origin + 1 : origin + 1 + max(horizons)]
                for step, value in enumerate(_recursive(model, list(values[: origin + 1]), ahead), 1):
                    if np.isnan(value):
                        break
                    if step in horizons:
                        rows.append((keys[0], step, int(group["t"].iloc[origin]), actual[origin + step], value))
        return pd.DataFrame(rows, columns=[key, "h", "t0", "actual", "pred"])

    return state_features(panel, column, (1, 2, 3, 6, 12)).groupBy(key).applyInPandas(run, f"{key} string, h int, t0 int, actual double, pred double")


def tune(panel: DataFrame, column: str, grid: Sequence[tuple[int, float, int]], key: str = "entity", folds: int = 3) -> DataFrame:
    """Mean validation RMSE by grid point over expanding folds of all entities; the least is selected."""
    points = panel.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(grid)], "point int, depth int, rate double, trees int")

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        depth, rate, trees = (group[c].iloc[0] for c in ("depth", "rate", "trees"))
        n = len(group)
        half, scores = n // 2, []
        size = (n - half) // (folds + 1)
        for i in range(folds if n >= 60 and size >= 5 else 0):
            end = half + i * size
            x, y = _training(group.iloc[:end], column, ())
            vx, vy = _training(group.iloc[end : end + size], column, ())
            if len(y) >= 30 and len(vy) >= 5:
                model = K.BoostedTrees(int(depth), float(rate), int(trees)).fit(x, y)
                scores.append((keys[0], keys[1], i, float(np.sqrt(np.mean((model.predict(vx) - vy) ** 2)))))
        return pd.DataFrame(scores, columns=[key, "point", "fold", "rmse"])

    tasks = state_features(panel, column, (1, 2, 3, 6, 12)).crossJoin(F.broadcast(points))
    scored = tasks.groupBy(key, "point").applyInPandas(run, f"{key} string, point int, fold int, rmse double")
    mean = scored.groupBy("point").agg(F.avg("rmse").alias("cv_rmse"), F.count("*").alias("n_folds"), F.countDistinct(key).alias("n_entities"))
    best = mean.agg(F.min(F.struct("cv_rmse", "point")).alias("b")).select(F.col("b.point").alias("best"))
    return points.join(mean, "point", "left").crossJoin(F.broadcast(best)).select("depth", "rate", "trees", "cv_rmse", (F.col("point") == F.col("best")).alias("selected"), "n_entities", "n_folds")


def _regular(values: pd.Series, limit: int = 6) -> np.ndarray:
    """From the first known month on, with inner gaps of up to ``limit`` months on a line; a longer gap is an error."""
    x = values.to_numpy(float)
    seen = np.flatnonzero(~np.isnan(x))
    if not len(seen):
        raise ValueError("no values")
    if np.diff(seen, append=len(x)).max(initial=1) > limit + 1:
        raise ValueError(f"a gap of more than {limit} months")
    return np.interp(np.arange(seen[0], len(x)), seen, x[seen])


def arima_forecast(panel: DataFrame, column: str, exog: Sequence[str], horizon: int, key: str = "entity") -> DataFrame:
    """Seasonal ARIMA forecast of the last rows of a panel on its whole calendar.

    ``exog`` are columns already shifted by their lags.  A fit that fails, a gap of
    more than six training months or a regressor gap in the test months gives a
    status instead; training months before all regressors start are left out.
    """

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        train, test = group.iloc[:-horizon], group.iloc[-horizon:]
        x = group[list(exog)].ffill(limit=6)
        pred, status, order = [np.nan] * len(test), None, None
        if exog and x.loc[test.index].isna().any().any():
            status = "ERROR: regressor gap in the test months"
        else:
            try:
                y = _regular(train[column])
                before = [_regular(x.loc[train.index, c]) for c in exog]
                n = min(len(v) for v in (y, *before))
                model = K.SeasonalArima.choose(y[-n:], np.column_stack([v[-n:] for v in before]) if exog else None)
                pred = model.forecast(len(test), x.loc[test.index].to_numpy(float) if exog else None)
                order = str(model.order)
            except (ValueError, np.linalg.LinAlgError) as error:
                status = f"ERROR: {error}"
        return pd.DataFrame({key: keys[0], "t": test["t"].to_numpy(), "actual": test[column].to_numpy(float), "pred": pred, "model_order": order, "status": status})

    return panel.groupBy(key).applyInPandas(run, f"{key} string, t int, actual double, pred double, model_order string, status string")


def rolling_arima(panel: DataFrame, column: str, horizons: Sequence[int], window: int, key: str = "entity") -> DataFrame:
    """One choice of orders on the training rows, refitted coefficients at every origin."""

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        n, rows = len(group), []
        actual = group[column].to_numpy(float)
        try:
            chosen = K.SeasonalArima.choose(_regular(group[column].iloc[: n - window]))
            for origin in range(n - window - 1, n - 1):
                p, d, q, sp, sd, sq = chosen.order
                path = K.SeasonalArima(p, d, q, sp, sd, sq).fit(_regular(group[column].iloc[: origin + 1])).forecast(max(horizons))
                rows += [(keys[0], h, int(group["t"].iloc[origin]), actual[origin + h], float(path[h - 1])) for h in horizons if origin + h < n]
        except (ValueError, np.linalg.LinAlgError):
            pass  # what was forecast before stays
        return pd.DataFrame(rows, columns=[key, "h", "t0", "actual", "pred"])

    return panel.groupBy(key).applyInPandas(run, f"{key} string, h int, t0 int, actual double, pred double")


#: Method registry: name, family, and the lag set it needs (None: no regressors).
METHODS = (
    ("Persistence", "persistence", None), ("SARIMA", "arima", None), ("SARIMAX_all_vars", "arima", "all"), ("SARIMAX_Stepwise", "arima", "stepwise"),
    ("SARIMAX_CCM_direct", "arima", "direct"), ("SARIMAX_CCM_ancestors", "arima", "ancestors"), ("SARIMAX_CCM_neighbor", "arima", "neighbor"), ("XGBoost_AR_only", "boosted", None),
    ("XGBoost_all_vars", "boosted", "all"), ("XGBoost_Stepwise", "boosted", "stepwise"), ("XGBoost_CCM_direct", "boosted", "direct"), ("XGBoost_CCM_ancestors", "boosted", "ancestors"),
    ("XGBoost_CCM_neighbor", "boosted", "neighbor"),
)


def runnable_methods(lag_sets: DataFrame, key: str = "entity") -> DataFrame:
    """Methods whose lag set is not empty, from ``lag_sets(entity, lag_set, n)``; neighbours need ancestors too."""
    spark = lag_sets.sparkSession
    registry = spark.createDataFrame([(m, f, s or "") for m, f, s in METHODS], "method string, family string, lag_set string")
    some = lag_sets.filter("n > 0").select(key, "lag_set").distinct()
    both = some.groupBy(key).agg(F.collect_set("lag_set").alias("sets"))
    ok = (F.col("lag_set") == "") | (F.array_contains("sets", F.col("lag_set")) & ((F.col("lag_set") != "neighbor") | F.array_contains("sets", F.lit("ancestors"))))
    return lag_sets.select(key).distinct().join(both, key, "left").crossJoin(F.broadcast(registry)).filter(F.coalesce(ok, F.col("lag_set") == "")).select(key, "method", "family")
