"""Graph closure and predictor-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DRIVER
from tidemark.operators import embedding as E
from tidemark.operators import features as X
from tidemark.operators import graph as G
from tidemark.operators import selection as Sel
from tidemark.operators.series import longest_gap, month_range, with_position
from tidemark.plans.lineage import cut
from tidemark.queries.base import Query, sql
from tidemark.queries.dynamics import _TOP, _lags_sql, _skill_sql
from tidemark.queries.panels import station_grid
from tidemark.queries.panels import stored_anomaly as anomaly
from tidemark.queries.statistics import tested
from tidemark.sources import tables as T


def _sink(spark, sf):
    links = T.nation_links(spark, sf)
    return links, links.groupBy("entity").agg(F.max("src").alias("target"))


def _ancestors(spark, sf):
    links, target = _sink(spark, sf)
    return G.ancestors(links, target).select(F.col("entity").cast("long").alias("entity"), F.col("node").cast("long").alias("node"))


def _components(spark, sf):
    links = T.nation_links(spark, sf).filter("(src + dst) % 3 <> 0")
    return G.components(links).select(*[F.col(c).cast("long").alias(c) for c in ("entity", "node", "component")])


def _closure(spark, sf):
    """Nations draining to the first one of their region along next-nation pointers, from outlet 24."""
    links = T.nation_links(spark, sf).filter("entity >= 2")
    pointers = links.select(F.col("src").alias("node"), F.col("dst").alias("down")).unionByName(spark.createDataFrame([(24, -1), (23, -1)], "node int, down int")).dropDuplicates(["node"])
    return G.upstream(pointers, 23).select(F.col("node").cast("long").alias("node"))


def _tier(spark, sf):
    nation = T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    links = T.nation_links(spark, sf).filter("(src + dst) % 3 <> 0")
    comp = G.components(links).select("node", "component")
    a, b = nation.toDF("a", "ra"), nation.toDF("b", "rb")
    direct = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(True).alias("direct")).distinct()
    p = a.crossJoin(b).filter("a < b").join(direct, ["a", "b"], "left").join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    tier = G.separation_tier(F.coalesce("direct", F.lit(False)), F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)), F.col("ra") == F.col("rb"))
    return p.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), tier.alias("tier"))


def _retained(spark, sf):
    return Sel.retained(tested(spark, sf)).select("cause", "effect", F.col("lag").cast("long").alias("lag"))


def _direct(spark, sf):
    maps = Sel.retained(tested(spark, sf)).groupBy("effect").agg(F.array_sort(F.collect_list(F.struct("cause", "lag"))).alias("m"))
    return maps.select("effect", F.to_json(F.map_from_entries("m")).alias("lags"))


def _reselected(spark, sf):
    """Direct lags of the panel's predictors below 1 replaced by the best lag a forecast may use."""
    p = anomaly(spark, sf)
    best = X.best_cross_correlation(p, "WL", T.VARIABLES, range(0, 13))
    forecast = X.best_cross_correlation(p, "WL", T.VARIABLES, DRIVER.forecast_lags)
    return Sel.reselect(best, forecast).select("entity", "variable", F.col("lag").cast("long").alias("lag"), F.col("old_lag").cast("long").alias("old_lag"))


def ancestor_pairs(spark, sf):
    """(entity, src, target, direct_lag) of every ancestor of an entity's sink."""
    links, target = _sink(spark, sf)
    every = G.ancestors(links, target).select("entity", F.col("node").alias("src"), "target")
    direct = links.select("entity", "src", F.col("dst").alias("target"), F.col("lag").alias("direct_lag"))
    return every.join(direct, ["entity", "src", "target"], "left")


def _ancestor_lags(spark, sf):
    """A direct edge's lag if a forecast may use it, else the lag of 1 to 12 at which the sink's states map the ancestor best."""
    pairs = cut(ancestor_pairs(spark, sf))
    nation = T.table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("key"))
    series = T.station_obs(spark, sf).join(F.broadcast(nation), F.col("station") == F.col("n_name")).select("key", "month", "value")
    months = month_range(series)
    asked = pairs.filter("direct_lag is null or direct_lag < 1").select("src", "target")
    grid = with_position(asked.crossJoin(F.broadcast(months)), ("src", "target"))
    x, y = series.toDF("src", "month", "x"), series.toDF("target", "month", "y")
    panel = cut(grid.join(x, ["src", "month"], "left").join(y, ["target", "month"], "left"))
    best = E.best_lag(E.cross_map(panel, "x", "y", 2, 1, DRIVER.forecast_lags, ("src", "target")), ("src", "target"))
    lag = F.when(F.col("direct_lag") >= 1, F.col("direct_lag")).otherwise(F.col("obs_lag"))
    named = pairs.join(best.select("src", "target", "obs_lag"), ["src", "target"], "left").withColumn("lag", lag).filter("lag is not null")
    return named.select(F.col("entity").cast("long").alias("entity"), F.col("src").cast("long").alias("node"), F.col("lag").cast("long").alias("lag"))


def _predictor_rows(spark, sf):
    """Old and new lags of every entity's selected predictors, as maps."""
    r = _reselected(spark, sf)

    def as_map(lag: str) -> F.Column:
        return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", lag)))))

    return r.groupBy("entity").agg(F.lit("cross-correlation").alias("method"), F.count("*").alias("n_predictors"), as_map("old_lag").alias("old_lags"), as_map("lag").alias("new_lags"))


def _neighbour_series(spark, sf):
    """Series of every station's neighbours without their own season, moved by the edge's lag; neighbours with long gaps are left out."""
    edges = Sel.retained(tested(spark, sf)).select("effect", "cause", "lag")
    grid = station_grid(spark, sf).select(F.col("station").alias("cause"), "month", "value")
    whole = longest_gap(grid, "value", ("cause",)).filter(F.col("longest_gap") <= DRIVER.max_gap).select("cause")
    flat = grid.join(whole, "cause").withColumn("x", F.col("value") - F.avg("value").over(Window.partitionBy("cause", F.month("month")))).filter("x is not null")
    moved = flat.join(F.broadcast(edges), "cause").select("effect", "cause", F.add_months("month", F.col("lag")).alias("month"), "x")
    return moved.join(grid.select(F.col("cause").alias("effect"), "month"), ["effect", "month"]).select("effect", "cause", "month", F.round("x", 2).alias("x"))


def _neighbours(spark, sf):
    """Incoming retained edges of every station, with the shortest lag of a station's neighbours first."""
    e = Sel.retained(tested(spark, sf))
    return e.withColumn("k", F.row_number().over(Window.partitionBy("effect").orderBy("lag", "cause"))).filter("k <= 3").select("effect", F.col("k").cast("long").alias("k"), "cause", F.col("lag").cast("long").alias("lag"))


def _stepwise(spark, sf):
    s = Sel.first_step(anomaly(spark, sf).filter("t <= n - 12"), "WL", T.VARIABLES)
    return s.select("entity", "variable", F.round("aic", 4).alias("aic"))


_CLOSE = """{name} AS (SELECT entity, src, dst FROM {e} UNION SELECT p.entity, p.src, l.dst FROM {name} p JOIN {e} l ON l.entity = p.entity AND l.src = p.dst)"""
_COMP = "l AS (SELECT entity, src, dst FROM links WHERE (src + dst) % 3 <> 0), b AS (SELECT * FROM l UNION ALL SELECT entity, dst, src FROM l), " + _CLOSE.format(name="c", e="b")

QUERIES = {
    "ancestors": Query(_ancestors, sql("WITH " + _CLOSE.format(name="c", e="links") + ", g AS (SELECT entity, max(src) AS target FROM links GROUP BY ALL) SELECT DISTINCT entity::BIGINT AS entity, src::BIGINT AS node FROM c JOIN g USING (entity) WHERE dst = target AND src <> target", "links")),
    "components": Query(_components, sql(f"WITH {_COMP} SELECT entity::BIGINT AS entity, src::BIGINT AS node, least(min(dst), src)::BIGINT AS component FROM c GROUP BY entity, src", "links")),
    "basin_closure": Query(_closure, sql("""WITH p AS (SELECT src AS node, dst AS down FROM links WHERE entity >= 2 UNION ALL SELECT 23, -1 WHERE 23 NOT IN (SELECT src FROM links WHERE entity >= 2)),
        u AS (SELECT 23 AS node UNION SELECT p.node FROM u JOIN p ON p.down = u.node) SELECT node::BIGINT AS node FROM u""", "links")),
    "separation_tier": Query(_tier, sql(f"""WITH {_COMP}, k AS (SELECT src AS node, least(min(dst), src) AS component FROM c GROUP BY src)
        SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b, CASE WHEN EXISTS (SELECT 1 FROM l WHERE least(l.src, l.dst) = a.n_nationkey AND greatest(l.src, l.dst) = b.n_nationkey) THEN '1 direct'
            WHEN coalesce(x.component = y.component, false) THEN '2 same component' WHEN a.n_regionkey = b.n_regionkey THEN '3 same system' ELSE '4 different system' END AS tier
        FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey LEFT JOIN k x ON x.node = a.n_nationkey LEFT JOIN k y ON y.node = b.n_nationkey""", "links")),
    "retained_edges": Query(_retained, sql("SELECT cause, effect, obs_lag::BIGINT AS lag FROM tested WHERE causal_evidence AND obs_lag >= 0", "tested")),
    "direct_predictors": Query(_direct, sql("""SELECT effect, '{' || string_agg('"' || cause || '":' || obs_lag, ',' ORDER BY cause) || '}' AS lags FROM tested WHERE causal_evidence AND obs_lag >= 0 GROUP BY effect""", "tested")),
    "reselected_lags": Query(_reselected, sql("""
        WITH u AS (UNPIVOT (SELECT entity, t, P, RegFlow, Temp, R, SWE, Evap FROM anomaly) ON P, RegFlow, Temp, R, SWE, Evap INTO NAME variable VALUE x),
        j AS (SELECT u.entity, variable, l AS lag, x, a.WL AS y FROM u, (SELECT unnest(range(0, 13)) AS l) JOIN anomaly a ON a.entity = u.entity AND a.t = u.t + l WHERE a.WL IS NOT NULL),
        c AS (SELECT entity, variable, lag, corr(x, y) AS r FROM j GROUP BY ALL HAVING count(*) >= 20 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY -abs(r), lag) AS k FROM c),
        f AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY -abs(r), lag) AS k FROM c WHERE lag >= 1)
        SELECT o.entity, o.variable, CASE WHEN o.lag >= 1 THEN o.lag ELSE f.lag END AS lag, o.lag AS old_lag FROM o JOIN f ON f.entity = o.entity AND f.variable = o.variable AND f.k = 1 WHERE o.k = 1""", "anomaly")),
    "ancestor_lags": Query(_ancestor_lags, sql("WITH " + _CLOSE.format(name="c", e="links") + """, g AS (SELECT entity, max(src) AS target FROM links GROUP BY ALL),
        a AS (SELECT DISTINCT c.entity, c.src, target, l.lag FROM c JOIN g USING (entity) LEFT JOIN links l ON l.entity = c.entity AND l.src = c.src AND l.dst = target WHERE c.dst = target AND c.src <> target),
        ser AS (SELECT n_nationkey AS key, month, value FROM station_obs JOIN nation ON station = n_name),
        mon AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM ser),
        anomaly AS (SELECT src || '>' || target AS entity, row_number() OVER (PARTITION BY src, target ORDER BY mon.month) AS t, x.value AS P, y.value AS WL
            FROM a CROSS JOIN mon LEFT JOIN ser x ON x.key = a.src AND x.month = mon.month LEFT JOIN ser y ON y.key = a.target AND y.month = mon.month WHERE a.lag IS NULL OR a.lag < 1),
        """ + _lags_sql("P", 2, DRIVER.forecast_lags) + ", " + _skill_sql(2, "entity, lag") + ", b AS (" + _TOP.format(c="lag::BIGINT AS lag") + """)
        SELECT a.entity::BIGINT AS entity, a.src::BIGINT AS node, (CASE WHEN a.lag >= 1 THEN a.lag ELSE b.lag END)::BIGINT AS lag FROM a LEFT JOIN b ON b.entity = a.src || '>' || a.target
        WHERE a.lag >= 1 OR b.lag IS NOT NULL""", "links", "station_obs")),
    "selected_predictors": Query(_predictor_rows, sql("""
        WITH u AS (UNPIVOT (SELECT entity, t, P, RegFlow, Temp, R, SWE, Evap FROM anomaly) ON P, RegFlow, Temp, R, SWE, Evap INTO NAME variable VALUE x),
        j AS (SELECT u.entity, variable, l AS lag, x, a.WL AS y FROM u, (SELECT unnest(range(0, 13)) AS l) JOIN anomaly a ON a.entity = u.entity AND a.t = u.t + l WHERE a.WL IS NOT NULL),
        c AS (SELECT entity, variable, lag, corr(x, y) AS r FROM j GROUP BY ALL HAVING count(*) >= 20 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY -abs(r), lag) AS k FROM c),
        f AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY -abs(r), lag) AS k FROM c WHERE lag >= 1),
        s AS (SELECT o.entity, o.variable, CASE WHEN o.lag >= 1 THEN o.lag ELSE f.lag END AS lag, o.lag AS old_lag FROM o JOIN f ON f.entity = o.entity AND f.variable = o.variable AND f.k = 1 WHERE o.k = 1)
        SELECT entity, 'cross-correlation' AS method, count(*) AS n_predictors, '{' || string_agg('"' || variable || '":' || old_lag, ',' ORDER BY variable) || '}' AS old_lags,
               '{' || string_agg('"' || variable || '":' || lag, ',' ORDER BY variable) || '}' AS new_lags FROM s GROUP BY entity""", "anomaly")),
    "neighbour_series": Query(_neighbour_series, sql("""
        WITH q AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY month) AS t FROM station_grid),
        i AS (SELECT station, t - row_number() OVER (PARTITION BY station ORDER BY t) AS isl FROM q WHERE value IS NULL),
        n AS (SELECT station, max(k) AS gap FROM (SELECT station, isl, count(*) AS k FROM i GROUP BY ALL) GROUP BY ALL),
        f AS (SELECT station, month, value - avg(value) OVER (PARTITION BY station, month(month)) AS x FROM station_grid LEFT JOIN n USING (station) WHERE coalesce(gap, 0) <= 6)
        SELECT effect, cause, g.month, round(x, 2) AS x FROM tested JOIN f ON f.station = cause JOIN station_grid g ON g.station = effect AND g.month = CAST(f.month + to_months(obs_lag::INTEGER) AS DATE)
        WHERE causal_evidence AND obs_lag >= 0 AND x IS NOT NULL""", "tested", "station_grid")),
    "neighbour_lags": Query(_neighbours, sql("""WITH k AS (SELECT effect, cause, obs_lag, row_number() OVER (PARTITION BY effect ORDER BY obs_lag, cause) AS k FROM tested WHERE causal_evidence AND obs_lag >= 0)
        SELECT effect, k, cause, obs_lag::BIGINT AS lag FROM k WHERE k <= 3""", "tested")),
    "stepwise_first_step": Query(_stepwise, sql("""
        WITH w AS (SELECT * FROM anomaly WHERE t <= n - 12 AND WL IS NOT NULL AND P IS NOT NULL AND RegFlow IS NOT NULL AND Temp IS NOT NULL AND R IS NOT NULL AND SWE IS NOT NULL AND Evap IS NOT NULL),
        u AS (UNPIVOT (SELECT entity, WL, P, RegFlow, Temp, R, SWE, Evap FROM w) ON P, RegFlow, Temp, R, SWE, Evap INTO NAME variable VALUE x),
        f AS (SELECT entity, variable, count(*) AS n, var_pop(WL) * count(*) AS sst, corr(x, WL) AS r FROM u GROUP BY ALL HAVING count(*) >= 20 AND stddev_pop(x) > 0),
        a AS (SELECT entity, variable, n * ln(2 * pi() * sst * (1 - r * r) / n) + n + 4 AS aic, n * ln(2 * pi() * sst / n) + n + 2 AS aic0 FROM f),
        o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY aic) AS k FROM a WHERE aic < aic0)
        SELECT entity, variable, round(aic, 4) AS aic FROM o WHERE k = 1""", "anomaly")),
}
