"""Forecast evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DRIVER
from tidemark.operators import evaluate as V
from tidemark.operators import stats as S
from tidemark.queries.base import Query, sql
from tidemark.queries.panels import stored_anomaly as anomaly
from tidemark.queries.statistics import PHI

WINDOW = 24
METRICS = ("rmse", "mae", "nse", "pbias")


def forecasts(spark, sf):
    a = anomaly(spark, sf)
    return {
        "persistence": V.rolling_persistence(a, "WL", DRIVER.rolling_horizons, WINDOW),
        "seasonal": V.rolling_seasonal(a, "WL", DRIVER.rolling_horizons, WINDOW),
    }


def scores(spark, sf):
    f = forecasts(spark, sf)
    every = f["persistence"].withColumn("method", F.lit("persistence")).unionByName(f["seasonal"].withColumn("method", F.lit("seasonal")))
    m = S.error_metrics(every, ["entity", "method", "h"])
    origins = every.groupBy("entity", "method", "h").agg(F.count("*").alias("n_origins"))
    return m.join(origins, ["entity", "method", "h"])


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in METRICS], "n_eval")


def _single(spark, sf):
    return _rounded(S.error_metrics(V.persistence(anomaly(spark, sf).filter("t <= 80").withColumn("n", F.least("n", F.lit(80))), "WL", DRIVER.horizon), ["entity"]), "entity")


def _rolling(spark, sf):
    r = scores(spark, sf).filter("method = 'persistence'")
    return _rounded(r.withColumn("h", F.col("h").cast("long")), "entity", "h", "n_origins")


def aligned(spark, sf):
    f = forecasts(spark, sf)
    return V.align(f["persistence"], f["seasonal"], least=2)


def _align(spark, sf):
    return aligned(spark, sf).select("entity", F.col("h").cast("long").alias("h"), F.col("t0").cast("long").alias("t0"), *[F.round(c, 2).alias(c) for c in ("actual", "p1", "p2")])


def dm(spark, sf):
    return S.diebold_mariano(aligned(spark, sf), ["entity"], least=5)


def _dm(spark, sf):
    return dm(spark, sf).select("entity", F.col("h").cast("long").alias("h"), F.round("dm_stat", 4).alias("dm_stat"), F.round("p_value", 6).alias("p_value"), "n")


def family(spark, sf):
    t = S.benjamini_hochberg(dm(spark, sf), "p_value")
    winner = F.when(F.coalesce(F.col("p_fdr") < 0.5, F.lit(False)), F.when(F.col("dm_stat") < 0, "persistence").otherwise("seasonal")).otherwise("")
    return t.withColumns({"sig_fdr": F.coalesce(F.col("p_fdr") < 0.5, F.lit(False)), "winner": winner})


def _family(spark, sf):
    return family(spark, sf).select("entity", F.col("h").cast("long").alias("h"), F.round("p_fdr", 6).alias("p_fdr"), "sig_fdr", "winner")


def _dm_summary(spark, sf):
    return family(spark, sf).filter("p_value is not null").groupBy(F.lit("persistence").alias("method_1"), F.lit("seasonal").alias("method_2")).agg(
        F.countDistinct("entity").alias("n_entities"), F.count("*").alias("n_tested"), F.count_if("sig_fdr").alias("n_significant"),
        F.count_if(F.col("winner") == "persistence").alias("n_favouring_1"), F.count_if(F.col("winner") == "seasonal").alias("n_favouring_2"),
    )


def _foresight(spark, sf):
    lags = spark.range(1, 16).select(F.col("id").alias("min_lag"))
    f = V.foresight(lags, "min_lag", DRIVER.horizon).withColumn("h", F.explode(F.array(*[F.lit(h) for h in DRIVER.rolling_horizons])))
    return f.select("min_lag", F.col("free_months").cast("long").alias("free_months"), F.round("frac_free", 6).alias("frac_free"), F.col("h").cast("long").alias("h"), (F.col("h") > F.col("min_lag")).alias("requires_foresight"))


def _matched(spark, sf):
    s = scores(spark, sf).filter("not (entity = 'ASIA' and h = 12 and method = 'seasonal')")
    kept = V.matched(s, "entity", ["method", "h"])
    n = kept.agg(F.countDistinct("entity").alias("n_entities"))
    wide = kept.groupBy("method").pivot("h", list(DRIVER.rolling_horizons)).agg(F.round(F.avg("rmse"), 2))
    return wide.crossJoin(F.broadcast(n)).select("method", "n_entities", *[F.col(str(h)).alias(f"rmse_h{h}") for h in DRIVER.rolling_horizons])


# Comparisons declared before any result; one method is not run here.
PAIRS = (("persistence", "seasonal"), ("persistence", "climatology"), ("seasonal", "climatology"), ("persistence", "arima"))


def _comparisons(spark, sf):
    """Every predeclared pair on its common origins: complete origins, mean loss difference and the better method."""
    f = forecasts(spark, sf)
    flat = f["persistence"].withColumn("pred", F.lit(0.0))  # the season's mean: no anomaly
    every = f["persistence"].withColumn("method", F.lit("persistence")).unionByName(f["seasonal"].withColumn("method", F.lit("seasonal"))).unionByName(flat.withColumn("method", F.lit("climatology")))
    both = V.compare(every, spark.createDataFrame(PAIRS, "method_1 string, method_2 string"), least=5)
    loss = (F.col("actual") - F.col("p1")) ** 2 - (F.col("actual") - F.col("p2")) ** 2
    t = both.groupBy("method_1", "method_2", "entity", "h").agg(F.count("*").alias("n_common"), F.avg(loss).alias("d"))
    return t.select("method_1", "method_2", "entity", F.col("h").cast("long").alias("h"), "n_common", F.round("d", 0).alias("mean_difference"), F.when(F.col("d") < 0, F.col("method_1")).otherwise(F.col("method_2")).alias("better"))


_M = """round(sqrt(avg((a - p) * (a - p))), 4) AS rmse, round(avg(abs(a - p)), 4) AS mae, round(CASE WHEN var_pop(a) > 0 THEN 1 - avg((a - p) * (a - p)) / var_pop(a) END, 4) AS nse,
    round(CASE WHEN NOT abs(sum(a)) < 1e-6 * greatest(1.0, sum(abs(a))) THEN 100 * sum(a - p) / sum(a) END, 4) AS pbias, count(a) AS n_eval"""
_CLEAN = "SELECT *, CASE WHEN actual IS NOT NULL AND pred IS NOT NULL THEN actual END AS a, CASE WHEN actual IS NOT NULL AND pred IS NOT NULL THEN pred END AS p FROM"
_ALIGN = """al AS (SELECT entity, h, t0, p.actual, p.pred AS p1, s.pred AS p2 FROM persist p JOIN seasonal s USING (entity, h, t0) QUALIFY count(*) OVER (PARTITION BY entity, h) >= 2)"""
_DM = _ALIGN + """,
    d AS (SELECT entity, h, (actual - p1) * (actual - p1) - (actual - p2) * (actual - p2) AS d, row_number() OVER (PARTITION BY entity, h ORDER BY t0) AS i FROM al WHERE actual IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL),
    b AS (SELECT entity, h, count(*) AS n, avg(d) AS mean, var_pop(d) AS var FROM d GROUP BY ALL),
    c AS (SELECT x.entity, x.h, y.i - x.i AS l, covar_pop(x.d, y.d) AS c FROM d x JOIN d y ON x.entity = y.entity AND x.h = y.h AND y.i - x.i BETWEEN 1 AND x.h - 1 GROUP BY ALL HAVING count(*) >= 2),
    e AS (SELECT entity, h, sum(2 * (1 - l / h) * c) AS extra FROM c GROUP BY ALL),
    t AS (SELECT entity, h, n, CASE WHEN n >= 5 THEN mean / sqrt(greatest(var + coalesce(extra, 0), 1e-12) / n) END AS dm_stat FROM b LEFT JOIN e USING (entity, h)),
    dm AS (SELECT *, 1 - 2 * (""" + PHI.format(a="abs(dm_stat)") + """) AS p_value FROM t)"""
_FAM = _DM + """,
    v AS (SELECT *, row_number() OVER (ORDER BY p_value, entity, h) AS rk, count(*) OVER () AS k FROM dm WHERE p_value IS NOT NULL),
    f AS (SELECT *, least(1.0::DOUBLE, min(p_value * k / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS p_fdr FROM v),
    g AS (SELECT d.entity, d.h, d.p_value, p_fdr, coalesce(p_fdr < 0.5, false) AS sig_fdr, CASE WHEN coalesce(p_fdr < 0.5, false) THEN CASE WHEN d.dm_stat < 0 THEN 'persistence' ELSE 'seasonal' END ELSE '' END AS winner FROM dm d LEFT JOIN f USING (entity, h))"""

QUERIES = {
    "persistence_single": Query(_single, sql(f"""
        WITH l AS (SELECT entity, WL AS pred FROM anomaly WHERE t = least(n, 80) - 12), x AS (SELECT a.entity, WL AS actual, pred FROM anomaly a JOIN l USING (entity) WHERE t > least(n, 80) - 12 AND t <= 80), y AS ({_CLEAN} x)
        SELECT entity, {_M} FROM y GROUP BY entity""", "anomaly")),
    "rolling_persistence": Query(_rolling, sql(f"WITH y AS ({_CLEAN} persist) SELECT entity, h::BIGINT AS h, count(*) AS n_origins, {_M} FROM y GROUP BY entity, h", "persist")),
    "align_origins": Query(_align, sql(f"WITH {_ALIGN} SELECT entity, h::BIGINT AS h, t0, round(actual, 2) AS actual, round(p1, 2) AS p1, round(p2, 2) AS p2 FROM al", "persist", "seasonal")),
    "dm_test": Query(_dm, sql(f"WITH {_DM} SELECT entity, h::BIGINT AS h, round(dm_stat, 4) AS dm_stat, round(p_value, 6) AS p_value, n FROM dm", "persist", "seasonal")),
    "dm_family_fdr": Query(_family, sql(f"WITH {_FAM} SELECT entity, h::BIGINT AS h, round(p_fdr, 6) AS p_fdr, sig_fdr, winner FROM g", "persist", "seasonal")),
    "dm_summary": Query(_dm_summary, sql(f"""WITH {_FAM} SELECT 'persistence' AS method_1, 'seasonal' AS method_2, count(DISTINCT entity) AS n_entities, count(*) AS n_tested, count(*) FILTER (sig_fdr) AS n_significant,
        count(*) FILTER (winner = 'persistence') AS n_favouring_1, count(*) FILTER (winner = 'seasonal') AS n_favouring_2 FROM g WHERE p_value IS NOT NULL""", "persist", "seasonal")),
    "method_comparisons": Query(_comparisons, sql("""
        WITH every AS (SELECT 'persistence' AS m, * FROM persist UNION ALL SELECT 'seasonal', * FROM seasonal UNION ALL SELECT 'climatology', entity, h, t0, actual, 0.0 FROM persist),
        p AS (SELECT * FROM (VALUES ('persistence', 'seasonal'), ('persistence', 'climatology'), ('seasonal', 'climatology'), ('persistence', 'arima')) v(method_1, method_2)),
        j AS (SELECT method_1, method_2, entity, h, power(a.actual - a.pred, 2) - power(a.actual - b.pred, 2) AS d FROM p JOIN every a ON a.m = method_1 JOIN every b USING (entity, h, t0)
              WHERE b.m = method_2 AND a.actual IS NOT NULL AND a.pred IS NOT NULL AND b.pred IS NOT NULL)
        SELECT method_1, method_2, entity, h::BIGINT AS h, count(*) AS n_common, round(avg(d), 0) AS mean_difference, CASE WHEN avg(d) < 0 THEN method_1 ELSE method_2 END AS better
        FROM j GROUP BY method_1, method_2, entity, h HAVING count(*) >= 5""", "persist", "seasonal")),
    "foresight_flags": Query(_foresight, """
        SELECT l AS min_lag, least(l, 12) AS free_months, round(least(l, 12) / 12, 6) AS frac_free, h::BIGINT AS h, h > l AS requires_foresight
        FROM (SELECT unnest(range(1, 16)) AS l), (VALUES (1), (3), (6), (12)) v(h)"""),
    "matched_mean_rmse": Query(_matched, sql(f"""
        WITH every AS (SELECT 'persistence' AS method, * FROM persist UNION ALL SELECT 'seasonal', * FROM seasonal), y AS ({_CLEAN} every),
        s AS (SELECT entity, method, h, sqrt(avg((a - p) * (a - p))) AS rmse FROM y GROUP BY ALL HAVING NOT (entity = 'ASIA' AND h = 12 AND method = 'seasonal')),
        k AS (SELECT entity FROM s GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT method, h FROM s)))
        SELECT method, (SELECT count(*) FROM k) AS n_entities, """ + ", ".join(f"round(avg(rmse) FILTER (h = {h}), 2) AS rmse_h{h}" for h in (1, 3, 6, 12)) + " FROM s JOIN k USING (entity) GROUP BY method", "persist", "seasonal")),
}
