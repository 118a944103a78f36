"""Gap, window and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DRIVER
from tidemark.operators import features as X
from tidemark.operators import quality as Q
from tidemark.operators import series as S
from tidemark.queries.base import Query, sql
from tidemark.queries.panels import anomaly, station_grid
from tidemark.sources import tables as T

KEYS = ("entity", "station")


def _longest(spark, sf):
    return S.longest_gap(station_grid(spark, sf), "value", KEYS)


def _spans(spark, sf):
    return S.gap_spans(S.complete_calendar(T.supplier_obs(spark, sf).filter("x > 22")), "x")


def _linear(spark, sf):
    filled = S.fill_gaps(S.complete_calendar(T.supplier_obs(spark, sf).filter("x > 24")), "x", DRIVER.max_gap)
    return filled.select("entity", "month", F.round("x", 4).alias("x"))


def _ffill(spark, sf):
    grid = S.complete_calendar(T.supplier_obs(spark, sf).filter("x > 24"))
    return grid.select("entity", "month", F.round(S.forward_fill("x", DRIVER.max_gap, S.over(("entity",), "month")), 4).alias("x"))


def _long_gap(spark, sf):
    """Suppliers whose longest gap is above the limit, and the rows left without them."""
    grid = S.complete_calendar(T.supplier_obs(spark, sf).filter("x > 24"))
    gaps = S.longest_gap(grid, "x")
    left = grid.join(gaps.filter(F.col("longest_gap") > DRIVER.max_gap), "entity", "left_anti").groupBy("entity").agg(F.count("x").alias("n_observed"))
    return gaps.join(left, "entity", "left").select("entity", "longest_gap", F.coalesce("n_observed", F.lit(0)).cast("long").alias("n_observed"))


def _state(spark, sf):
    f = X.state_features(anomaly(spark, sf), "WL", DRIVER.ar_lags)
    return f.select("entity", "month", *[F.round(c, 2).alias(c.lower()) for c in X.STATE_NAMES])


def _exog(spark, sf):
    f = X.exogenous_features(anomaly(spark, sf), {"P": 2, "Temp": 5}, DRIVER.antecedent_windows)
    return f.select("entity", "month", *[F.round(c, 4).alias(c.lower()) for v in ("P", "Temp") for c in X.exog_names(v, DRIVER.antecedent_windows)])


def _box(spark, sf):
    b = Q.box_stats(station_grid(spark, sf), "value", KEYS)
    return b.select(*KEYS, *[F.round(c, 2).alias(c) for c in ("q1", "med", "q3", "whisker_low", "whisker_high")], "n_fliers")


def _xcorr(spark, sf):
    best = X.best_cross_correlation(anomaly(spark, sf), "WL", T.VARIABLES, DRIVER.forecast_lags)
    return best.select("entity", "variable", F.col("lag").cast("long").alias("lag"), F.round("r", 6).alias("r"))


def _folds(spark, sf):
    return S.expanding_folds(T.supplier_obs(spark, sf)).select("entity", F.col("fold").cast("long").alias("fold"), "train_end", "val_end")


def _changes(spark, sf):
    d = S.difference_of_observed(station_grid(spark, sf), "value", KEYS)
    return d.select(*KEYS, "month", F.round(F.col("change") / (F.col("value") - F.col("change")), 8).alias("relative_change"))


def _fixed(spark, sf):
    f = S.fixed_calendar(T.supplier_obs(spark, sf), "1994-01-01", "2024-12-01")
    return f.groupBy("entity").agg(F.count("*").alias("n"), F.count("x").alias("n_observed"))


_SPARSE = """WITH g AS (
        SELECT entity, month, x, row_number() OVER (PARTITION BY entity ORDER BY month) AS t, count(*) OVER (PARTITION BY entity) AS n FROM
          (SELECT entity, CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS month FROM
             (SELECT entity, min(month) AS a, max(month) AS z FROM supplier_obs WHERE x > {0} GROUP BY ALL))
          LEFT JOIN (SELECT * FROM supplier_obs WHERE x > {0}) USING (entity, month)),
        i AS (SELECT *, t - row_number() OVER (PARTITION BY entity ORDER BY t) AS isl FROM g WHERE x IS NULL),
        r AS (SELECT entity, isl, min(month) AS a, max(month) AS z, count(*) AS c FROM i GROUP BY ALL),
        l AS (SELECT entity, coalesce(max(c), 0) AS longest_gap FROM (SELECT DISTINCT entity FROM g) LEFT JOIN r USING (entity) GROUP BY ALL)"""
_L = [1, 2, 3, 6, 12]
_LAG = "lag(WL, {}) OVER w"

QUERIES = {
    "longest_gap": Query(_longest, sql("""
        WITH p AS (SELECT *, row_number() OVER (PARTITION BY entity, station ORDER BY month) AS t FROM station_grid),
        i AS (SELECT entity, station, t - row_number() OVER (PARTITION BY entity, station ORDER BY t) AS isl FROM p WHERE value IS NULL),
        r AS (SELECT entity, station, isl, count(*) AS c FROM i GROUP BY ALL)
        SELECT entity, station, coalesce(max(c), 0) AS longest_gap FROM (SELECT DISTINCT entity, station FROM p) LEFT JOIN r USING (entity, station) GROUP BY ALL""", "station_grid")),
    "gap_spans": Query(_spans, sql(_SPARSE.format(22) + """
        SELECT r.entity, a AS "start", CAST(CASE WHEN z < mx THEN z + INTERVAL 1 MONTH ELSE z END AS DATE) AS "end", c AS "length"
        FROM r JOIN (SELECT entity, max(month) AS mx FROM g GROUP BY ALL) USING (entity) WHERE c >= 2""", "supplier_obs")),
    "gap_fill_linear": Query(_linear, sql(_SPARSE.format(24) + """,
        f AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, first_value(x IGNORE NULLS) OVER a AS x1,
                last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1
              FROM g WINDOW b AS (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY entity ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT entity, month, round(CASE WHEN x IS NOT NULL THEN x WHEN coalesce(t1, n + 1) - coalesce(t0, 0) - 1 <= 6
            THEN coalesce(x0 + (x1 - x0) * (t - t0) / (t1 - t0), x0, x1) END, 4) AS x FROM f""", "supplier_obs")),
    "ffill_limit": Query(_ffill, sql(_SPARSE.format(24) + """
        SELECT entity, month, round(last_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS x FROM g""", "supplier_obs")),
    "long_gap_exclusion": Query(_long_gap, sql(_SPARSE.format(24) + """
        SELECT l.entity, longest_gap, CASE WHEN longest_gap > 6 THEN 0 ELSE count(x) END AS n_observed FROM l JOIN g USING (entity) GROUP BY l.entity, longest_gap""", "supplier_obs")),
    "wl_state_features": Query(_state, sql("SELECT entity, month, " + ", ".join(f"round({_LAG.format(k)}, 2) AS wl_lag{k}" for k in _L) + f""",
            round({_LAG.format(1)} - {_LAG.format(2)}, 2) AS wl_diff1, round({_LAG.format(1)} - {_LAG.format(4)}, 2) AS wl_diff3,
            round(CASE WHEN count(WL) OVER w3 = 3 THEN avg(WL) OVER w3 END, 2) AS wl_mean3, round(CASE WHEN count(WL) OVER w6 = 6 THEN avg(WL) OVER w6 END, 2) AS wl_mean6,
            round(CASE WHEN count(WL) OVER w3 = 3 THEN stddev_samp(WL) OVER w3 END, 2) AS wl_std3
        FROM anomaly WINDOW w AS (PARTITION BY entity ORDER BY t), w3 AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
            w6 AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""", "anomaly")),
    "exog_antecedent_features": Query(_exog, sql("SELECT entity, month, " + ", ".join(
        f"round(lag({v}, {k}) OVER w, 4) AS {v.lower()}_lag{k}" if n == 0 else
        f"round(CASE WHEN count({v}) OVER (w ROWS BETWEEN {k + n - 1} PRECEDING AND {k} PRECEDING) = {n} THEN avg({v}) OVER (w ROWS BETWEEN {k + n - 1} PRECEDING AND {k} PRECEDING) END, 4) AS {v.lower()}_mean{n}"
        for v, k in (("P", 2), ("Temp", 5)) for n in (0, 3, 6)).replace("p_lag2", "p_lag").replace("temp_lag5", "temp_lag") + " FROM anomaly WINDOW w AS (PARTITION BY entity ORDER BY t)", "anomaly")),
    "box_stats": Query(_box, sql("""
        WITH q AS (SELECT entity, station, value, quantile_cont(value, 0.25) OVER p AS q1, quantile_cont(value, 0.5) OVER p AS med, quantile_cont(value, 0.75) OVER p AS q3
                   FROM station_grid WHERE value IS NOT NULL WINDOW p AS (PARTITION BY entity, station)),
        f AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM q)
        SELECT entity, station, round(max(q1), 2) AS q1, round(max(med), 2) AS med, round(max(q3), 2) AS q3,
               round(min(value) FILTER (inside), 2) AS whisker_low, round(max(value) FILTER (inside), 2) AS whisker_high, count(*) FILTER (NOT inside) AS n_fliers
        FROM f GROUP BY entity, station""", "station_grid")),
    "xcorr_best_lag": Query(_xcorr, sql("""
        WITH u AS (UNPIVOT (SELECT entity, t, P, RegFlow, Temp, R, SWE, Evap FROM anomaly) ON P, RegFlow, Temp, R, SWE, Evap INTO NAME variable VALUE x),
        j AS (SELECT u.entity, variable, l AS lag, x, a.WL AS y FROM u, (SELECT unnest(range(1, 13)) AS l) JOIN anomaly a ON a.entity = u.entity AND a.t = u.t + l WHERE a.WL IS NOT NULL),
        c AS (SELECT entity, variable, lag, corr(x, y) AS r FROM j GROUP BY ALL HAVING count(*) >= 20 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY -abs(r), lag) AS k FROM c)
        SELECT entity, variable, lag, round(r, 6) AS r FROM o WHERE k = 1""", "anomaly")),
    "expanding_folds": Query(_folds, sql("""
        WITH n AS (SELECT entity, count(*) AS n FROM supplier_obs GROUP BY ALL), s AS (SELECT *, n // 2 AS half, (n - n // 2) // 4 AS size FROM n)
        SELECT entity, f AS fold, half + size * (f - 1) AS train_end, half + size * f AS val_end FROM s, (SELECT unnest(range(1, 4)) AS f) WHERE size >= 5""", "supplier_obs")),
    "observed_changes": Query(_changes, sql("""
        SELECT entity, station, month, round(value / lag(value) OVER (PARTITION BY entity, station ORDER BY month) - 1, 8) AS relative_change FROM station_obs""", "station_obs")),
    "fixed_calendar": Query(_fixed, sql("SELECT entity, 372::BIGINT AS n, count(x) AS n_observed FROM supplier_obs GROUP BY ALL", "supplier_obs")),
}
