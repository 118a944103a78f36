"""Report-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DRIVER
from tidemark.functions.scalar import pair_key
from tidemark.operators import embedding as E
from tidemark.operators import features as X
from tidemark.operators import report as R
from tidemark.plans.lineage import cut
from tidemark.queries.base import Query, sql
from tidemark.queries.dynamics import _simplex_sql
from tidemark.queries.evaluation import forecasts
from tidemark.queries.graphs import _COMP
from tidemark.queries.graphs import _tier as tier_of_pairs
from tidemark.queries.panels import station_grid
from tidemark.queries.panels import stored_anomaly as anomaly
from tidemark.queries.statistics import _PAIRS, pairs, tested
from tidemark.sources import tables as T

_METHODS = ("F", "O", "P")
_TIERS = f"""{_COMP}, k AS (SELECT src AS node, least(min(dst), src) AS component FROM c GROUP BY src),
    tr AS (SELECT least(a.n_name, b.n_name) || '|' || greatest(a.n_name, b.n_name) AS pair, CASE WHEN EXISTS (SELECT 1 FROM l WHERE least(l.src, l.dst) = a.n_nationkey AND greatest(l.src, l.dst) = b.n_nationkey) THEN '1 direct'
        WHEN coalesce(x.component = y.component, false) THEN '2 same component' WHEN a.n_regionkey = b.n_regionkey THEN '3 same system' ELSE '4 different system' END AS tier
        FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey LEFT JOIN k x ON x.node = a.n_nationkey LEFT JOIN k y ON y.node = b.n_nationkey)"""
_TITLE = "list_aggregate(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"


def _drivers(spark, sf):
    d = R.supported_drivers(tested(spark, sf), ["GERMANY", "CHINA", "FRANCE"], {"UNITED STATES": "USA", "UNITED KINGDOM": "UK"})
    return d


def _configs(spark, sf):
    """Fits by region and order status: failed where the mean is low, an order text, or a count."""
    o = T.table(spark, sf, "orders").join(T.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fits = o.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("method")).agg(F.count("*").alias("n"))
    fits = fits.filter("not (segment = 'BUILDING' and method = 'P')").select(
        "segment", "method", F.when(F.col("segment") == "MACHINERY", "ERROR: gap").alias("status"),
        F.when(F.col("method") == "F", F.format_string("(%d, 0, 1)", F.col("n") % 3)).alias("model_order"), F.when(F.col("method") == "O", F.col("n") % 7).alias("n_exog"),
    )
    return R.configurations(fits, "segment", _METHODS).select("segment", *[F.col(m).alias(m.lower()) for m in _METHODS])


def _stations(spark, sf):
    g = station_grid(spark, sf).filter("value is not null").groupBy("entity", "station").agg(F.min("month").alias("a"), F.max("month").alias("z"))
    return g.groupBy("entity").agg(F.count("*").alias("n_stations"), F.array_join(F.array_sort(F.collect_list("station")), "; ").alias("stations"), F.concat_ws(" to ", F.date_format(F.min("a"), "yyyy-MM"), F.date_format(F.max("z"), "yyyy-MM")).alias("period"))


def _dims(spark, sf):
    """Entity by variable: the chosen dimension."""
    a = anomaly(spark, sf)
    parts = [E.select_dimension(E.simplex(a, v, DRIVER.embed_dims)).select("entity", F.lit(v).alias("variable"), "E") for v in ("WL", "SWE")]
    return parts[0].unionByName(parts[1]).groupBy("entity").pivot("variable", ["SWE", "WL"]).agg(F.first("E")).select("entity", F.col("SWE").cast("long").alias("swe"), F.col("WL").cast("long").alias("wl"))


def _tuning(spark, sf):
    """Mean score by grid point over folds, with the chosen point marked."""
    i = T.table(spark, sf, "lineitem").select((F.col("l_quantity") % 6).cast("long").alias("point"), "l_discount")
    mean = i.groupBy("point").agg(F.avg("l_discount").alias("score"), F.count("*").alias("n_folds"))
    best = mean.agg(F.min(F.struct("score", "point")).alias("b")).select(F.col("b.point").alias("best"))
    return mean.crossJoin(F.broadcast(best)).select("point", F.round("score", 8).alias("score"), "n_folds", (F.col("point") == F.col("best")).alias("selected"))


def _layers(spark, sf):
    """Positive, contemporaneous and negative edges with a drawing width and order."""
    e = tested(spark, sf).filter("significant")
    width = 1.5 + 3 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("obs_rho") - 0.0) / 0.3))
    layer = F.when(F.col("obs_lag") > 0, "positive").when(F.col("obs_lag") == 0, "contemporaneous").otherwise("negative")
    return e.select("cause", "effect", layer.alias("layer"), F.round(width, 4).alias("width"))


#: Assertions over the tested edges: the rows that offend.
_OFFENDING = {
    "lags in range": "obs_lag NOT BETWEEN -12 AND 12",
    "p values in range": "p_value NOT BETWEEN 0 AND 1",
    "adjusted p not below p": "p_fdr < p_value - 1e-9",
    "skills in range": "abs(obs_rho) > 1 + 1e-9",
    "statuses known": "status NOT IN ('OK', 'insufficient_data')",
    "tested edges have p": "status = 'OK' AND obs_rho IS NOT NULL AND p_value IS NULL",
    "significant edges converge": "significant AND NOT coalesce(converges, false)",
    "evidence has no negative lag": "causal_evidence AND obs_lag < 0",
    "no significant edge": "significant",
}


def _checks(spark, sf):
    n = T.table(spark, sf, "nation")
    e = cut(tested(spark, sf))
    dims = E.select_dimension(E.simplex(anomaly(spark, sf), "WL", DRIVER.embed_dims))
    wanted = spark.createDataFrame([(h,) for h in DRIVER.rolling_horizons], "h int")
    scored = forecasts(spark, sf)["persistence"].select("h").distinct()
    return R.checks(
        {
            "all pairs tested once": e.groupBy("cause", "effect").count().filter("count <> 1"),
            "causes are stations": e.join(n, F.col("cause") == F.col("n_name"), "left_anti"),
            "dimensions in range": dims.filter("E not between 2 and 10"),
            "all horizons forecast": wanted.join(scored, "h", "left_anti"),
            **{name: e.filter(condition) for name, condition in _OFFENDING.items()},
        }
    )


def _tiers(spark, sf):
    """Tier of every unordered pair of stations, by name."""
    n = T.table(spark, sf, "nation")
    names = [n.select(F.col("n_nationkey").cast("long").alias(c), F.col("n_name").alias(f"name_{c}")) for c in "ab"]
    t = tier_of_pairs(spark, sf).join(F.broadcast(names[0]), "a").join(F.broadcast(names[1]), "b")
    return t.select(pair_key("name_a", "name_b").alias("pair"), "tier")


def _between(spark, sf):
    """Significant edges between stations, negative lags too, with the pair's tier, in order of report."""
    e = tested(spark, sf).filter("significant").withColumn("pair", pair_key("cause", "effect")).join(_tiers(spark, sf), "pair")
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc(F.round("obs_rho", 6)), "cause", "effect"))
    return e.select("cause", "effect", F.col("obs_lag").cast("long").alias("obs_lag"), F.round("obs_rho", 3).alias("rho"), F.round("p_fdr", 4).alias("p_fdr"), "lag_resolution", "tier", place.cast("long").alias("place"))


def _pair_table(spark, sf):
    """Pairs with display names, strength, tier and their place by tier and falling strength."""
    p = pairs(spark, sf).join(_tiers(spark, sf), "pair").withColumn("s", F.round("strength", 6))
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("s"), "pair"))
    first, second = (F.initcap(F.split("pair", r"\|")[k]) for k in (0, 1))
    return p.select(first.alias("first"), second.alias("second"), F.col("s").alias("strength"), "detected", F.col("connected").alias("directly_connected"), "tier", place.cast("long").alias("place"))


def _within(spark, sf):
    """Edges within an entity with the embedding of their effect."""
    a = anomaly(spark, sf)
    best = X.best_cross_correlation(a, "WL", T.VARIABLES, range(1, 13))
    dims = E.select_dimension(E.simplex(a, "WL", DRIVER.embed_dims)).select("entity", F.lit("WL").alias("effect"), F.col("E").cast("long").alias("E_effect"), F.lit(DRIVER.tau).cast("long").alias("tau"))
    edges = best.select("entity", F.col("variable").alias("cause"), F.lit("WL").alias("effect"), F.col("lag").cast("long").alias("obs_lag"), F.round("r", 6).alias("rho"))
    return edges.join(F.broadcast(dims), ["entity", "effect"])


def _counts(spark, sf):
    """In how many stations of a region an edge from a region is significant."""
    place = T.table(spark, sf, "nation").join(T.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    e = tested(spark, sf).filter("significant").join(F.broadcast(place.toDF("cause", "cause_region")), "cause").join(F.broadcast(place.toDF("effect", "effect_region")), "effect")
    return e.groupBy("cause_region", "effect_region").agg(F.countDistinct("effect").alias("n_entities"), F.count("*").alias("n_edges"))


def _status_list(spark, sf):
    """Every supplier's series with what keeps it from being used, if anything does."""
    m = T.supplier_obs(spark, sf).groupBy("entity").agg(F.count("x").alias("n"), F.max("month").alias("last"))
    status = F.when(F.col("n") < DRIVER.min_months, F.concat(F.lit("insufficient_data: "), F.col("n"), F.lit(" months"))).when(F.col("last") < F.lit("1998-10-01").cast("date"), "ended_early").otherwise("OK")
    return m.select("entity", "n", status.alias("status"), (status != "OK").alias("failed"))


_ORDER = ("WL", "SWE")


def _placement(spark, sf):
    """Cells of a matrix: the entity's row, the variable's column and the value there."""
    long = _dims(spark, sf).unpivot("entity", ["wl", "swe"], "variable", "value")
    column = F.array_position(F.array(*[F.lit(v.lower()) for v in _ORDER]), F.col("variable"))
    return long.select((F.dense_rank().over(Window.orderBy("entity"))).cast("long").alias("row"), column.cast("long").alias("column"), "entity", "variable", "value")


QUERIES = {
    "between_edges": Query(_between, sql(f"""WITH {_TIERS} SELECT cause, effect, obs_lag::BIGINT AS obs_lag, round(obs_rho, 3) AS rho, round(p_fdr, 4) AS p_fdr, lag_resolution, tier,
        row_number() OVER (PARTITION BY tier ORDER BY round(obs_rho, 6) DESC, cause, effect) AS place FROM tested JOIN tr ON pair = least(cause, effect) || '|' || greatest(cause, effect) WHERE significant""", "links", "tested")),
    "pair_table": Query(_pair_table, sql(f"""WITH {_TIERS}, {_PAIRS}, x AS (SELECT pair, round(strength, 6) AS strength, detected, connected, tier FROM pr JOIN tr USING (pair)),
        w AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY strength DESC, pair) AS place FROM x)
        SELECT {_TITLE.format(x="split_part(pair, '|', 1)")} AS "first", {_TITLE.format(x="split_part(pair, '|', 2)")} AS "second", strength, detected, connected AS directly_connected, tier, place FROM w""", "links", "tested")),
    "within_edges": Query(_within, sql(f"""
        WITH z AS ({_simplex_sql('WL')}), d AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY -rho, dim) AS k FROM z WHERE rho IS NOT NULL),
        u AS (UNPIVOT (SELECT entity, t, P, RegFlow, Temp, R, SWE, Evap FROM anomaly) ON P, RegFlow, Temp, R, SWE, Evap INTO NAME variable VALUE x),
        j AS (SELECT u.entity, variable, l AS lag, x, a.WL AS y FROM u, (SELECT unnest(range(1, 13)) AS l) JOIN anomaly a ON a.entity = u.entity AND a.t = u.t + l WHERE a.WL IS NOT NULL),
        c AS (SELECT entity, variable, lag, corr(x, y) AS r FROM j GROUP BY ALL HAVING count(*) >= 20 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY -abs(r), lag) AS k FROM c)
        SELECT o.entity, 'WL' AS effect, variable AS cause, lag AS obs_lag, round(r, 6) AS rho, dim AS E_effect, 1::BIGINT AS tau FROM o JOIN d USING (entity) WHERE o.k = 1 AND d.k = 1""", "anomaly")),
    "edge_entity_counts": Query(_counts, sql("""
        SELECT a.r_name AS cause_region, b.r_name AS effect_region, count(DISTINCT effect) AS n_entities, count(*) AS n_edges FROM tested
        JOIN nation x ON x.n_name = cause JOIN region a ON a.r_regionkey = x.n_regionkey JOIN nation y ON y.n_name = effect JOIN region b ON b.r_regionkey = y.n_regionkey WHERE significant GROUP BY ALL""", "tested")),
    "acquisition_status": Query(_status_list, sql("""
        WITH m AS (SELECT entity, count(x) AS n, max(month) AS last FROM supplier_obs GROUP BY ALL),
        s AS (SELECT *, CASE WHEN n < 60 THEN 'insufficient_data: ' || n || ' months' WHEN last < DATE '1998-10-01' THEN 'ended_early' ELSE 'OK' END AS status FROM m)
        SELECT entity, n, status, status <> 'OK' AS failed FROM s""", "supplier_obs")),
    "matrix_cells": Query(_placement, sql(f"""WITH a AS ({_simplex_sql('SWE')}), b AS ({_simplex_sql('WL')}),
        u AS (SELECT 'swe' AS v, * FROM a UNION ALL SELECT 'wl', * FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY v, entity ORDER BY -rho, dim) AS k FROM u WHERE rho IS NOT NULL)
        SELECT dense_rank() OVER (ORDER BY entity) AS "row", (CASE v WHEN 'wl' THEN 1 ELSE 2 END)::BIGINT AS "column", entity, v AS variable, dim AS value FROM o WHERE k = 1""", "anomaly")),
    "supported_drivers": Query(_drivers, sql("""
        SELECT CASE cause WHEN 'GERMANY' THEN 1 WHEN 'CHINA' THEN 2 WHEN 'FRANCE' THEN 3 ELSE 4 END::BIGINT AS place, CASE cause WHEN 'UNITED STATES' THEN 'USA' WHEN 'UNITED KINGDOM' THEN 'UK' ELSE cause END AS driver,
               effect, round(obs_rho, 3) AS rho, printf('%+d', obs_lag) AS lag, printf('%.1e', p_fdr) AS p_fdr, CASE WHEN causal_evidence THEN 'Yes' ELSE 'No' END AS evidence FROM tested WHERE significant""", "tested")),
    "model_config_pivot": Query(_configs, """
        WITH f AS (SELECT c_mktsegment AS segment, o_orderstatus AS method, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING NOT (c_mktsegment = 'BUILDING' AND o_orderstatus = 'P')),
        c AS (SELECT segment, method, CASE WHEN segment = 'MACHINERY' THEN 'failed' WHEN method = 'F' THEN '(' || (n % 3) || ',0,1)' WHEN method = 'O' AND n % 7 > 0 THEN (n % 7)::VARCHAR ELSE 'no exogenous' END AS cell FROM f)
        SELECT segment, """ + ", ".join(f"coalesce(max(cell) FILTER (method = '{m}'), 'not applicable') AS {m.lower()}" for m in _METHODS) + " FROM c GROUP BY segment"),
    "station_report": Query(_stations, sql("""
        SELECT entity, count(DISTINCT station) AS n_stations, string_agg(DISTINCT station, '; ' ORDER BY station) AS stations, strftime(min(month), '%Y-%m') || ' to ' || strftime(max(month), '%Y-%m') AS period FROM station_obs GROUP BY entity""", "station_obs")),
    "embedding_matrix": Query(_dims, sql(f"""WITH a AS ({_simplex_sql('SWE')}), b AS ({_simplex_sql('WL')}),
        u AS (SELECT 'swe' AS v, * FROM a UNION ALL SELECT 'wl', * FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY v, entity ORDER BY -rho, dim) AS k FROM u WHERE rho IS NOT NULL)
        SELECT entity, max(dim) FILTER (v = 'swe') AS swe, max(dim) FILTER (v = 'wl') AS wl FROM o WHERE k = 1 GROUP BY entity""", "anomaly")),
    "tuning_table": Query(_tuning, """
        WITH m AS (SELECT (l_quantity % 6)::BIGINT AS point, avg(l_discount) AS score, count(*) AS n_folds FROM lineitem GROUP BY ALL)
        SELECT point, round(score, 8) AS score, n_folds, row_number() OVER (ORDER BY score, point) = 1 AS selected FROM m"""),
    "network_layers": Query(_layers, sql("""
        SELECT cause, effect, CASE WHEN obs_lag > 0 THEN 'positive' WHEN obs_lag = 0 THEN 'contemporaneous' ELSE 'negative' END AS layer,
               round(1.5 + 3 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, obs_rho / 0.3)), 4) AS width FROM tested WHERE significant""", "tested")),
    "output_checks": Query(_checks, sql(f"""WITH q AS ({_simplex_sql('WL')})
        SELECT 'all pairs tested once' AS "check", count(*) = 0 AS ok FROM (SELECT 1 FROM tested GROUP BY cause, effect HAVING count(*) <> 1)
        UNION ALL SELECT 'causes are stations', count(*) = 0 FROM tested WHERE cause NOT IN (SELECT n_name FROM nation)
        UNION ALL SELECT 'dimensions in range', count(*) = 0 FROM q WHERE dim NOT BETWEEN 2 AND 10
        UNION ALL SELECT 'all horizons forecast', count(DISTINCT h) = 4 FROM persist WHERE h IN (1, 3, 6, 12)
        """ + " ".join(f"UNION ALL SELECT '{name}', count(*) = 0 FROM tested WHERE {condition}" for name, condition in _OFFENDING.items()), "tested", "persist")),
}
