"""Station, cleaning and panel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DRIVER
from tidemark.functions.scalar import as_bool, fingerprint, seed_of, to_number, to_unit
from tidemark.operators import panel as P
from tidemark.operators import quality as Q
from tidemark.operators import series as S
from tidemark.operators.ranks import average_rank
from tidemark.plans.lineage import cut
from tidemark.queries.base import Query, sql
from tidemark.sources import tables as T

VARIABLES = ("WL", *T.VARIABLES)


def station_grid(spark: SparkSession, sf: str) -> DataFrame:
    return S.complete_calendar(T.station_obs(spark, sf), ("entity", "station"), common=True)


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return Q.outliers(T.station_obs(spark, sf), z_change=DRIVER.z_change, z_level=DRIVER.z_level, min_diffs=DRIVER.min_diffs)


def level(spark: SparkSession, sf: str) -> DataFrame:
    return P.combine_stations(Q.blank(station_grid(spark, sf), flags(spark, sf)))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return P.align([level(spark, sf).withColumnRenamed("wl", "WL"), T.driver_obs(spark, sf)])


def anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return P.deseasonalise(panel(spark, sf), VARIABLES, DRIVER.horizon)


def stored_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    """The same, computed once and stored: for plans that read it several times."""
    return cut(anomaly(spark, sf))


def _station_panel(spark, sf):
    grid = station_grid(spark, sf)
    known = grid.groupBy("entity", "month").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("k"))
    coverage = known.groupBy("entity").agg(F.round(F.avg("k"), 6).alias("coverage"))
    return grid.join(F.broadcast(coverage), "entity").select("entity", "station", "month", F.round("value", 3).alias("value"), "coverage")


def _outlier_screen(spark, sf):
    return flags(spark, sf).select("entity", "station", "month", F.round("value", 3).alias("value"))


def _clean_and_combine(spark, sf):
    return level(spark, sf).select("entity", "month", F.round("wl", 2).alias("wl"))


def _deseasonalised_panel(spark, sf):
    places = {"Temp": 6, "R": 6}
    return anomaly(spark, sf).select("entity", "month", F.col("t").cast("long").alias("t"), *[F.round(v, places.get(v, 2)).alias(v.lower()) for v in VARIABLES])


def _regulated_sum(spark, sf):
    return P.regulated_sum(station_grid(spark, sf), years=(1996, 2000)).select("entity", "month", F.round(F.col("flow") / 30.4375, 4).alias("flow_per_day"))


def _unit_conversion(spark, sf):
    d = T.driver_obs(spark, sf)
    return d.select(
        "entity", "month",
        F.round(to_unit(F.col("Temp"), "K"), 6).alias("t_c"),
        F.round(to_unit(F.col("R"), "m"), 6).alias("r_mm"),
        F.round(to_unit(F.col("Temp"), "m/day", F.col("month")), 6).alias("p_mm"),
        F.round(to_unit(F.col("R"), "-m/day", F.col("month")), 6).alias("e_mm"),
    )


def _month_offset(spark, sf):
    return S.month_offset(T.supplier_obs(spark, sf)).select("entity", "month", F.col("offset").cast("long").alias("offset"))


def _availability(spark, sf):
    grid = station_grid(spark, sf)
    gaps = S.longest_gap(grid, "value", ("entity", "station"))
    a = Q.availability(grid, "value", ("entity", "station")).join(gaps, ["entity", "station"])
    return a.select("entity", "station", "n_months", "n_observed", "n_missing", "longest_gap", *[F.round(c, 2).alias(c) for c in ("coverage_pct", "sd", "iqr", "range")])


def _completeness(spark, sf):
    long = panel(spark, sf).unpivot(["entity"], list(VARIABLES), "variable", "x").filter("not (entity = 'ASIA' and variable = 'R')")
    wide = long.groupBy("entity").pivot("variable", list(VARIABLES)).agg(100 * F.avg(F.col("x").isNotNull().cast("double")))
    return wide.select("entity", *[F.when(F.col(v).isNull(), "not applicable").otherwise(F.format_string("%.1f", v)).alias(v.lower()) for v in VARIABLES])


def _truthy(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in (" TRUE ", "1", "yes", "no", "0", "3.5", "abc", "")]), (F.col("event_id") % 8 + 1).cast("int")).alias("raw"))
    return e.select("event_id", as_bool("raw").alias("flag"), to_number("raw").alias("x"))


def _fingerprint(spark, sf):
    n = T.table(spark, sf, "nation")
    return n.select("n_nationkey", seed_of("n_name", F.lit("WL")).alias("seed"), fingerprint(F.col("n_name")).alias("fingerprint"), F.date_format(F.make_date(F.lit(1994) + F.col("n_nationkey"), F.lit(2), F.lit(1)), "yyyy-MM").alias("month"))


def _centred(spark, sf):
    return P.centred(level(spark, sf), "wl").select("entity", "month", F.round("wl", 2).alias("wl"))


def _pair_panel(spark, sf):
    """Outer join of two entities' levels on the union of their months."""
    lv = level(spark, sf)
    a, b = (lv.filter(F.col("entity") == e).select("month", F.col("wl").alias(n)) for e, n in (("ASIA", "cause"), ("EUROPE", "effect")))
    return a.filter("month < date'2001-01-01'").join(b.filter("month > date'1995-06-01'"), "month", "full_outer").select("month", F.round("cause", 2).alias("cause"), F.round("effect", 2).alias("effect"))


def _dataset_stack(spark, sf):
    """Raw and deseasonalised levels stacked into one long table."""
    raw = level(spark, sf).select("entity", F.date_format("month", "yyyy-MM").alias("month"), F.lit("raw").alias("kind"), F.round("wl", 2).alias("wl"))
    flat = anomaly(spark, sf).filter("WL is not null").select("entity", F.date_format("month", "yyyy-MM").alias("month"), F.lit("deseasonalised").alias("kind"), F.round("WL", 2).alias("wl"))
    return raw.unionByName(flat)


def _supplier_rank(spark, sf):
    """Average-tie ranks of suppliers by their number of months."""
    n = T.supplier_obs(spark, sf).groupBy("entity").agg(F.count("*").alias("months"))
    return average_rank(n, "months").select("entity", "months", F.col("rank").cast("double").alias("rank"))


_D = ", ".join(f"round({v}, {6 if v in ('Temp', 'R') else 2}) AS {v.lower()}" for v in VARIABLES)

QUERIES = {
    "deseasonalised_panel": Query(_deseasonalised_panel, sql(f"SELECT entity, month, t, {_D} FROM anomaly", "anomaly")),
    "station_panel": Query(_station_panel, sql("""
        WITH k AS (SELECT entity, month, avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS k FROM station_grid GROUP BY ALL),
        c AS (SELECT entity, round(avg(k), 6) AS coverage FROM k GROUP BY ALL)
        SELECT entity, station, month, round(value, 3) AS value, coverage FROM station_grid JOIN c USING (entity)""", "station_grid")),
    "outlier_screen": Query(_outlier_screen, sql("SELECT entity, station, month, round(value, 3) AS value FROM outliers", "outliers")),
    "clean_and_combine": Query(_clean_and_combine, sql("SELECT entity, month, round(wl, 2) AS wl FROM level", "level")),
    "regulated_sum": Query(_regulated_sum, sql("""
        WITH f AS (SELECT entity, count(DISTINCT station) AS n FROM station_grid WHERE value IS NOT NULL GROUP BY ALL)
        SELECT entity, month, CASE WHEN year(month) BETWEEN 1996 AND 2000 AND count(value) = any_value(n) THEN round(sum(value) / 30.4375::DOUBLE, 4) END AS flow_per_day
        FROM station_grid JOIN f USING (entity) GROUP BY entity, month""", "station_grid")),
    "unit_conversion": Query(_unit_conversion, sql("""
        SELECT entity, month, round(Temp - 273.15, 6) AS t_c, round(R * 1000.0, 6) AS r_mm,
               round(Temp * 1000.0 * day(last_day(month)), 6) AS p_mm, round(-(R * 1000.0 * day(last_day(month))), 6) AS e_mm FROM driver_obs""", "driver_obs")),
    "month_offset": Query(_month_offset, sql("""
        SELECT entity, month, year(month) * 12 + month(month) - min(year(month) * 12 + month(month)) OVER (PARTITION BY entity) + 1 AS "offset" FROM supplier_obs""", "supplier_obs")),
    "availability_stats": Query(_availability, sql("""
        WITH p AS (SELECT *, row_number() OVER (PARTITION BY entity, station ORDER BY month) AS t FROM station_grid),
        i AS (SELECT entity, station, t - row_number() OVER (PARTITION BY entity, station ORDER BY month) AS isl FROM p WHERE value IS NULL),
        g AS (SELECT entity, station, max(c) AS longest FROM (SELECT entity, station, isl, count(*) AS c FROM i GROUP BY ALL) GROUP BY ALL)
        SELECT entity, station, count(*) AS n_months, count(value) AS n_observed, count(*) - count(value) AS n_missing, coalesce(any_value(longest), 0) AS longest_gap,
               round(100.0 * count(value) / count(*), 2) AS coverage_pct, round(stddev_samp(value), 2) AS sd,
               round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 2) AS iqr, round(max(value) - min(value), 2) AS "range"
        FROM station_grid LEFT JOIN g USING (entity, station) GROUP BY entity, station""", "station_grid")),
    "completeness_matrix": Query(_completeness, sql("SELECT entity, " + ", ".join(
        ("CASE WHEN entity = 'ASIA' THEN 'not applicable' ELSE " if v == "R" else "") + f"format('{{:.1f}}', 100 * avg(CASE WHEN {v} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END))" + (" END" if v == "R" else "") + f" AS {v.lower()}"
        for v in VARIABLES) + " FROM panel GROUP BY entity", "panel")),
    "truthy_coercion": Query(_truthy, """
        WITH e AS (SELECT event_id, ([' TRUE ', '1', 'yes', 'no', '0', '3.5', 'abc', ''])[event_id % 8 + 1] AS raw FROM events)
        SELECT event_id, lower(trim(raw)) IN ('true', '1', 'yes') AS flag, TRY_CAST(raw AS DOUBLE) AS x FROM e"""),
    "hash_fingerprint": Query(_fingerprint, """
        SELECT n_nationkey, CAST('0x' || substr(md5(n_name || '|WL'), 1, 8) AS BIGINT) AS seed, substr(sha256(n_name), 1, 16) AS fingerprint,
               strftime(make_date(1994 + n_nationkey, 2, 1), '%Y-%m') AS month FROM nation"""),
    "centred_series": Query(_centred, sql("SELECT entity, month, round(wl - avg(wl) OVER (PARTITION BY entity), 2) AS wl FROM level", "level")),
    "pair_panel": Query(_pair_panel, sql("""
        WITH a AS (SELECT month, wl FROM level WHERE entity = 'ASIA' AND month < DATE '2001-01-01'), b AS (SELECT month, wl FROM level WHERE entity = 'EUROPE' AND month > DATE '1995-06-01')
        SELECT month, round(a.wl, 2) AS cause, round(b.wl, 2) AS effect FROM a FULL OUTER JOIN b USING (month)""", "level")),
    "dataset_stack": Query(_dataset_stack, sql("""
        SELECT entity, strftime(month, '%Y-%m') AS month, 'raw' AS kind, round(wl, 2) AS wl FROM level
        UNION ALL SELECT entity, strftime(month, '%Y-%m'), 'deseasonalised', round(WL, 2) FROM anomaly WHERE WL IS NOT NULL""", "level", "anomaly")),
    "average_tie_rank": Query(_supplier_rank, sql("""
        WITH n AS (SELECT entity, count(*) AS months FROM supplier_obs GROUP BY ALL)
        SELECT entity, months, CAST(rank() OVER (ORDER BY months) + (count(*) OVER (PARTITION BY months) - 1) / 2 AS DOUBLE) AS rank FROM n""", "supplier_obs")),
}
