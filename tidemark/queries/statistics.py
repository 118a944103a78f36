"""Test, false-discovery and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import pair_key
from tidemark.operators import features as X
from tidemark.operators import stats as S
from tidemark.queries.base import Query, sql
from tidemark.queries.panels import anomaly, panel
from tidemark.sources import tables as T

ALPHA = 0.995


def edges(spark, sf):
    """Directed station pairs: correlation at a fixed lag with an approximate p-value."""
    nation = T.table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("key"))
    index = F.year("month") * 12 + F.month("month")
    obs = T.station_obs(spark, sf).join(F.broadcast(nation), F.col("station") == F.col("n_name")).select("key", index.alias("m"), "value")
    a, b = nation.select(F.col("n_name").alias("cause"), F.col("key").alias("ca")), nation.select(F.col("n_name").alias("effect"), F.col("key").alias("ef"))
    grid = a.crossJoin(b).filter("ca <> ef").withColumn("obs_lag", F.pmod(F.col("ca") * 7 + F.col("ef") * 3, F.lit(25)) - 12)
    left = grid.join(obs.select(F.col("key").alias("ca"), F.col("m").alias("m"), F.col("value").alias("x")), "ca").withColumn("m", F.col("m") + F.col("obs_lag"))
    pairs = left.join(obs.select(F.col("key").alias("ef"), "m", F.col("value").alias("y")), ["ef", "m"])
    s = pairs.groupBy("cause", "effect", "obs_lag").agg(F.count("*").alias("obs_n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    s = s.withColumn("obs_rho", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))))
    enough = F.col("obs_n") >= 20
    return s.select(
        "cause", "effect", F.when(enough, "OK").otherwise("insufficient_data").alias("status"), "obs_lag", "obs_rho", "obs_n",
        F.when(enough, 2 / (1 + F.exp(1.702 * F.abs("obs_rho") * F.sqrt("obs_n")))).alias("p_value"),
        F.when(F.abs("obs_rho") > 0.02, (F.col("obs_rho") > 0) | (F.abs("obs_rho") > 0.05)).alias("converges"),
    )


def tested(spark, sf):
    return S.classify_edges(edges(spark, sf), ALPHA)


def _bh(spark, sf):
    return tested(spark, sf).select("cause", "effect", F.round("p_value", 6).alias("p_value"), F.round("p_fdr", 6).alias("p_fdr"))


def _evidence(spark, sf):
    return tested(spark, sf).select("cause", "effect", "status", F.col("obs_lag").cast("long").alias("obs_lag"), F.round("obs_rho", 6).alias("obs_rho"), "obs_n", "significant", "lag_resolution", "causal_evidence")


def _nulls(spark, sf):
    """|r| at lag 1 of every predictor against |r| at the other lags."""
    r = X.cross_correlations(anomaly(spark, sf), "WL", T.VARIABLES, range(1, 13)).withColumn("a", F.abs("r"))
    first = r.filter("lag = 1").select("entity", "variable", F.col("a").alias("obs"))
    p = S.surrogate_p(r.filter("lag > 1").join(first, ["entity", "variable"]), ["entity", "variable"], "a", "obs")
    return p.select("entity", "variable", *[F.round(c, 6).alias(c) for c in ("observed", "p_value", "null_mean", "null_std")], "n_valid")


def _kendall(spark, sf):
    long = panel(spark, sf).filter("t <= 12").select("entity", F.col("t").cast("double").alias("size"), F.round("WL", 4).alias("rho"))
    return S.kendall_tau(long, "size", "rho", ["entity"]).select("entity", F.round("tau", 6).alias("tau"))


def pairs(spark, sf):
    """Unordered pairs: mean strength, whether one region holds both, any evidence."""
    places = T.table(spark, sf, "nation").select("n_name", "n_regionkey")
    e = tested(spark, sf).filter("status = 'OK'")
    e = e.join(F.broadcast(places.toDF("cause", "r1")), "cause").join(F.broadcast(places.toDF("effect", "r2")), "effect")
    e = e.withColumns({"pair": pair_key("cause", "effect"), "connected": F.col("r1") == F.col("r2")})
    return e.groupBy("pair").agg(F.avg(F.abs("obs_rho")).alias("strength"), F.bool_or("connected").alias("connected"), F.bool_or("causal_evidence").alias("detected"))


def _pairs(spark, sf):
    return pairs(spark, sf).select("pair", F.round("strength", 6).alias("strength"), "connected", "detected")


def _mann_whitney(spark, sf):
    t = S.mann_whitney(pairs(spark, sf), "strength", "connected")
    return t.select("n1", "n2", F.round("u", 2).alias("u"), F.round("auc", 6).alias("auc"), F.round("p_value", 6).alias("p_value"))


def _summary(spark, sf):
    """Counts, medians and shares of connected and unconnected edges and pairs."""
    places = T.table(spark, sf, "nation").select("n_name", "n_regionkey")
    e = tested(spark, sf).filter("status = 'OK'").join(F.broadcast(places.toDF("cause", "r1")), "cause").join(F.broadcast(places.toDF("effect", "r2")), "effect")
    by_edge = e.select(F.lit("edge").alias("unit"), (F.col("r1") == F.col("r2")).alias("c"), F.abs("obs_rho").alias("x"), "causal_evidence")
    by_pair = pairs(spark, sf).select(F.lit("pair").alias("unit"), F.col("connected").alias("c"), F.col("strength").alias("x"), F.col("detected").alias("causal_evidence"))
    both = by_edge.unionByName(by_pair)
    yes, no = F.col("c"), ~F.col("c")
    base = both.groupBy("unit").agg(
        F.count_if(yes).alias("n_connected"), F.count_if(no).alias("n_unconnected"),
        F.round(F.median(F.when(yes, F.col("x"))), 6).alias("median_connected"), F.round(F.median(F.when(no, F.col("x"))), 6).alias("median_unconnected"),
        F.round(F.avg(F.when(yes, F.col("causal_evidence").cast("double"))), 6).alias("frac_connected"), F.round(F.avg(F.when(no, F.col("causal_evidence").cast("double"))), 6).alias("frac_unconnected"),
    )
    test = S.mann_whitney(both, "x", "c", ["unit"]).select("unit", F.round("u", 2).alias("u"), F.round("auc", 6).alias("auc"))
    return base.join(test, "unit")


def _tasks(spark, sf):
    """All directed pairs of a region's stations: the tasks of a run."""
    n = T.table(spark, sf, "nation").select("n_regionkey", "n_name")
    return n.toDF("n_regionkey", "cause").join(n.toDF("n_regionkey", "effect"), "n_regionkey").filter("cause <> effect").select("cause", "effect", F.concat_ws("__", "cause", "effect").alias("shard"))


def _missing(spark, sf):
    """Tasks without a finished edge, and finished edges that are no task."""
    done = tested(spark, sf).filter("significant").select("cause", "effect")
    want = _tasks(spark, sf).select("cause", "effect")
    return want.join(done, ["cause", "effect"], "left_anti").withColumn("kind", F.lit("missing")).unionByName(done.join(want, ["cause", "effect"], "left_anti").withColumn("kind", F.lit("unexpected")))


def _signs(spark, sf):
    s = tested(spark, sf).filter("significant").select(F.count_if(F.col("obs_lag") > 0).alias("n_positive"), F.count_if(F.col("obs_lag") == 0).alias("n_zero"), F.count_if(F.col("obs_lag") < 0).alias("n_negative"))
    return s


def _status(spark, sf):
    return tested(spark, sf).groupBy("status", "lag_resolution").agg(F.count("*").alias("n"))


_PAIRS = """pr AS (SELECT least(cause, effect) || '|' || greatest(cause, effect) AS pair, avg(abs(obs_rho)) AS strength,
            bool_or(a.n_regionkey = b.n_regionkey) AS connected, bool_or(causal_evidence) AS detected
        FROM tested JOIN nation a ON a.n_name = cause JOIN nation b ON b.n_name = effect WHERE status = 'OK' GROUP BY 1)"""
PHI = """list_sum(list_transform(range(0, 61), lambda n: exp((2*n+1) * ln(greatest(least({a}, 6.0), 1e-300)) - (lgamma(2*n+2) - n * ln(2) - lgamma(n+1))))) * exp(-least({a}, 6.0)*least({a}, 6.0)/2) / 2.5066282746310002"""

QUERIES = {
    "bh_fdr": Query(_bh, sql("SELECT cause, effect, round(p_value, 6) AS p_value, round(p_fdr, 6) AS p_fdr FROM tested", "tested")),
    "causal_evidence": Query(_evidence, sql("SELECT cause, effect, status, obs_lag::BIGINT AS obs_lag, round(obs_rho, 6) AS obs_rho, obs_n, significant, lag_resolution, causal_evidence FROM tested", "tested")),
    "edge_test_pvalue": Query(_nulls, sql("""
        WITH u AS (UNPIVOT (SELECT entity, t, P, RegFlow, Temp, R, SWE, Evap FROM anomaly) ON P, RegFlow, Temp, R, SWE, Evap INTO NAME variable VALUE x),
        j AS (SELECT u.entity, variable, l AS lag, x, a.WL AS y FROM u, (SELECT unnest(range(1, 13)) AS l) JOIN anomaly a ON a.entity = u.entity AND a.t = u.t + l WHERE a.WL IS NOT NULL),
        c AS (SELECT entity, variable, lag, abs(corr(x, y)) AS a FROM j GROUP BY ALL HAVING count(*) >= 20 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0)
        SELECT n.entity, n.variable, round(max(o.a), 6) AS observed, round((count(*) FILTER (n.a >= o.a) + 1) / (count(n.a) + 1), 6) AS p_value,
               round(avg(n.a), 6) AS null_mean, round(stddev_pop(n.a), 6) AS null_std, count(n.a) AS n_valid
        FROM c n JOIN c o ON o.entity = n.entity AND o.variable = n.variable AND o.lag = 1 WHERE n.lag > 1 GROUP BY ALL""", "anomaly")),
    "kendall_tau": Query(_kendall, sql("""
        WITH v AS (SELECT entity, t::DOUBLE AS x, round(WL, 4) AS y FROM panel WHERE t <= 12 AND WL IS NOT NULL),
        p AS (SELECT a.entity, sign(b.x - a.x) AS sx, sign(b.y - a.y) AS sy FROM v a JOIN v b ON a.entity = b.entity AND a.x < b.x)
        SELECT entity, round(sum(sx * sy) / sqrt(sum(abs(sx))::DOUBLE * sum(abs(sy))), 6) AS tau FROM p GROUP BY entity""", "panel")),
    "pair_strength": Query(_pairs, sql(f"WITH {_PAIRS} SELECT pair, round(strength, 6) AS strength, connected, detected FROM pr", "tested")),
    "mann_whitney": Query(_mann_whitney, sql(f"""WITH {_PAIRS},
        k AS (SELECT connected, rank() OVER (ORDER BY strength) + (count(*) OVER (PARTITION BY strength) - 1) / 2 AS rk, count(*) OVER (PARTITION BY strength) AS t FROM pr),
        s AS (SELECT count(*) FILTER (connected) AS n1, count(*) FILTER (NOT connected) AS n2, sum(rk) FILTER (connected) AS r1, sum(t * t - 1) AS ties FROM k),
        u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS v FROM s),
        z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5::DOUBLE) / sqrt(v) AS z FROM u)
        SELECT n1, n2, round(u, 2) AS u, round(u / (n1 * n2), 6) AS auc,
               round(least(1.0::DOUBLE, CASE WHEN z >= 0 THEN 1 - 2 * ({PHI.format(a='abs(z)')}) ELSE 1 + 2 * ({PHI.format(a='abs(z)')}) END), 6) AS p_value FROM z""", "tested")),
    "connectivity_summary": Query(_summary, sql(f"""WITH {_PAIRS},
        e AS (SELECT 'edge' AS unit, a.n_regionkey = b.n_regionkey AS c, abs(obs_rho) AS x, causal_evidence AS ev FROM tested JOIN nation a ON a.n_name = cause JOIN nation b ON b.n_name = effect WHERE status = 'OK'
              UNION ALL SELECT 'pair', connected, strength, detected FROM pr),
        k AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2 AS rk FROM e)
        SELECT unit, count(*) FILTER (c) AS n_connected, count(*) FILTER (NOT c) AS n_unconnected, round(median(x) FILTER (c), 6) AS median_connected,
               round(median(x) FILTER (NOT c), 6) AS median_unconnected, round(avg(ev::INT::DOUBLE) FILTER (c), 6) AS frac_connected, round(avg(ev::INT::DOUBLE) FILTER (NOT c), 6) AS frac_unconnected,
               round(sum(rk) FILTER (c) - count(*) FILTER (c) * (count(*) FILTER (c) + 1) / 2, 2) AS u,
               round((sum(rk) FILTER (c) - count(*) FILTER (c) * (count(*) FILTER (c) + 1) / 2) / (count(*) FILTER (c) * count(*) FILTER (NOT c)), 6) AS auc
        FROM k GROUP BY unit""", "tested")),
    "edge_task_grid": Query(_tasks, "SELECT a.n_name AS cause, b.n_name AS effect, a.n_name || '__' || b.n_name AS shard FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_name <> b.n_name"),
    "missing_edges": Query(_missing, sql("""
        WITH w AS (SELECT a.n_name AS cause, b.n_name AS effect FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_name <> b.n_name), d AS (SELECT cause, effect FROM tested WHERE significant)
        SELECT cause, effect, 'missing' AS kind FROM (FROM w EXCEPT FROM d) UNION ALL SELECT cause, effect, 'unexpected' FROM (FROM d EXCEPT FROM w)""", "tested")),
    "lag_sign_counts": Query(_signs, sql("SELECT count(*) FILTER (obs_lag > 0) AS n_positive, count(*) FILTER (obs_lag = 0) AS n_zero, count(*) FILTER (obs_lag < 0) AS n_negative FROM tested WHERE significant", "tested")),
    "status_counts": Query(_status, sql("SELECT status, lag_resolution, count(*) AS n FROM tested GROUP BY ALL", "tested")),
}
