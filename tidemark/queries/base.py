"""Query registry and the SQL views that the counterparts share."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


VIEWS = {
    "located": """located AS (
        SELECT o.*, n_nationkey, n_name, r_name FROM orders o
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "station_obs": """station_obs AS (
        SELECT r_name AS entity, n_name AS station, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS value
        FROM located GROUP BY ALL)""",
    "driver_obs": """driver_obs AS (
        SELECT r_name AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS P,
               sum(l_extendedprice * (1 - l_discount)) AS RegFlow, avg(l_discount) AS Temp, avg(l_tax) AS R,
               CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS SWE, avg(l_extendedprice) AS Evap
        FROM lineitem JOIN located ON l_orderkey = o_orderkey GROUP BY ALL)""",
    "supplier_obs": """supplier_obs AS (
        SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_quantity) AS x FROM lineitem GROUP BY ALL)""",
    "event_hours": """event_hours AS (
        SELECT event_type AS entity, CAST(floor(epoch(ts) / 3600) - (SELECT min(floor(epoch(ts) / 3600)) FROM events) AS INTEGER) AS t, avg(value) AS x
        FROM events GROUP BY ALL)""",
    "station_grid": """station_grid AS (
        SELECT entity, station, month, value FROM
          (SELECT DISTINCT entity, station FROM station_obs) CROSS JOIN
          (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM station_obs)
        LEFT JOIN station_obs USING (entity, station, month))""",
    "outliers": """outliers AS (
        WITH d AS (SELECT entity, station, month, value, value - lag(value) OVER (PARTITION BY entity, station ORDER BY month) AS change FROM station_obs),
        m AS (SELECT entity, station, median(change) AS med, count(change) AS k FROM d GROUP BY ALL),
        a AS (SELECT entity, station, any_value(med) AS med, any_value(k) AS k, median(abs(change - med)) AS mad FROM d JOIN m USING (entity, station) GROUP BY ALL),
        c AS (SELECT entity, station, month FROM d JOIN a USING (entity, station) WHERE k >= 10 AND mad > 0 AND abs(change - med) / (1.4826 * mad) > 3.0),
        cand AS (SELECT DISTINCT entity, station, CAST(month - to_months(b) AS DATE) AS month FROM c, (VALUES (0), (1)) v(b)),
        lm AS (SELECT entity, station, median(value) AS med FROM station_obs GROUP BY ALL),
        la AS (SELECT entity, station, any_value(med) AS med, median(abs(value - med)) AS mad FROM station_obs JOIN lm USING (entity, station) GROUP BY ALL)
        SELECT entity, station, month, value FROM station_obs JOIN cand USING (entity, station, month) JOIN la USING (entity, station)
        WHERE mad > 0 AND abs(value - med) / (1.4826 * mad) > 2.0)""",
    "level": """level AS (
        WITH clean AS (SELECT g.entity, g.station, g.month, CASE WHEN o.month IS NULL THEN g.value END AS value
                       FROM station_grid g LEFT JOIN outliers o USING (entity, station, month)),
        sm AS (SELECT entity, station, avg(value) AS m FROM clean GROUP BY ALL),
        em AS (SELECT entity, avg(m) AS base FROM sm GROUP BY ALL)
        SELECT entity, month, avg(value - m) + any_value(base) AS wl FROM clean JOIN sm USING (entity, station) JOIN em USING (entity) GROUP BY entity, month)""",
    "panel": """panel AS (
        WITH months AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
                        FROM (SELECT month FROM level UNION ALL SELECT month FROM driver_obs)),
        grid AS (SELECT entity, month FROM (SELECT DISTINCT entity FROM level), months)
        SELECT entity, month, row_number() OVER (PARTITION BY entity ORDER BY month) AS t, count(*) OVER (PARTITION BY entity) AS n,
               wl AS WL, P, RegFlow, Temp, R, SWE, Evap
        FROM grid LEFT JOIN level USING (entity, month) LEFT JOIN driver_obs USING (entity, month))""",
    "anomaly": """anomaly AS (
        SELECT entity, month, t, n, """
    + ", ".join(f"{v} - avg(CASE WHEN t <= n - 12 THEN {v} END) OVER (PARTITION BY entity, month(month)) AS {v}" for v in ("WL", "P", "RegFlow", "Temp", "R", "SWE", "Evap"))
    + """ FROM panel)""",
    "edges": """edges AS (
        WITH k AS (SELECT n_name, n_nationkey FROM nation),
        s AS (SELECT station, n_nationkey AS key, year(month) * 12 + month(month) AS m, value FROM station_obs JOIN k ON station = n_name),
        pairs AS (SELECT a.n_nationkey AS ca, b.n_nationkey AS ef, (a.n_nationkey * 7 + b.n_nationkey * 3) % 25 - 12 AS obs_lag FROM k a JOIN k b ON a.n_nationkey <> b.n_nationkey),
        j AS (SELECT ca, ef, obs_lag, count(*) AS n, corr(x.value, y.value) AS rho
              FROM pairs JOIN s x ON x.key = ca JOIN s y ON y.key = ef AND y.m = x.m + obs_lag GROUP BY ALL)
        SELECT a.n_name AS cause, b.n_name AS effect, CASE WHEN n >= 20 THEN 'OK' ELSE 'insufficient_data' END AS status,
               obs_lag, rho AS obs_rho, n AS obs_n, CASE WHEN n >= 20 THEN 2 / (1 + exp(1.702 * abs(rho) * sqrt(n))) END AS p_value,
               CASE WHEN abs(rho) > 0.02 THEN rho > 0 OR abs(rho) > 0.05 END AS converges
        FROM j JOIN nation a ON ca = a.n_nationkey JOIN nation b ON ef = b.n_nationkey)""",
    "tested": """tested AS (
        WITH valid AS (SELECT *, row_number() OVER (ORDER BY p_value, cause, effect) AS rk, count(*) OVER () AS k FROM edges WHERE status = 'OK' AND p_value IS NOT NULL),
        adj AS (SELECT cause, effect, least(1.0, min(p_value * k / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS p_fdr FROM valid),
        sig AS (SELECT e.*, p_fdr, coalesce(p_fdr < 0.995 AND coalesce(converges, false) AND obs_lag IS NOT NULL, false) AS significant
                FROM edges e LEFT JOIN adj USING (cause, effect))
        SELECT *, CASE WHEN NOT significant THEN 'not_significant' WHEN obs_lag > 0 THEN 'resolved' WHEN obs_lag = 0 THEN 'unresolved_contemporaneous' ELSE 'rejected_reverse' END AS lag_resolution,
               significant AND obs_lag >= 0 AS causal_evidence FROM sig)""",
    "links": """links AS (
        WITH nx AS (SELECT a.n_regionkey AS entity, a.n_nationkey AS src, min(b.n_nationkey) AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey GROUP BY ALL),
        back AS (SELECT n_regionkey AS entity, max(n_nationkey) AS src, min(n_nationkey) AS dst FROM nation WHERE n_regionkey < 2 GROUP BY ALL),
        u AS (SELECT * FROM nx UNION ALL SELECT * FROM back)
        SELECT entity, src, dst, (src * 7 + dst * 3) % 16 - 4 AS lag FROM u)""",
    "persist": """persist AS (
        SELECT a.entity, h, a.t AS t0, b.WL AS actual, a.WL AS pred
        FROM anomaly a, (VALUES (1), (3), (6), (12)) v(h) JOIN anomaly b ON b.entity = a.entity AND b.t = a.t + h
        WHERE a.t >= a.n - 24 AND a.WL IS NOT NULL)""",
    "seasonal": """seasonal AS (
        SELECT a.entity, h, a.t AS t0, b.WL AS actual, c.WL AS pred
        FROM anomaly a, (VALUES (1), (3), (6), (12)) v(h) JOIN anomaly b ON b.entity = a.entity AND b.t = a.t + h
        JOIN anomaly c ON c.entity = a.entity AND c.t = a.t + h - 12
        WHERE a.t >= a.n - 24 AND c.WL IS NOT NULL)""",
}
_NEEDS = {
    "station_obs": ("located",),
    "driver_obs": ("located",),
    "station_grid": ("station_obs",),
    "outliers": ("station_obs",),
    "level": ("station_grid", "outliers"),
    "panel": ("level", "driver_obs"),
    "anomaly": ("panel",),
    "edges": ("station_obs",),
    "tested": ("edges",),
    "persist": ("anomaly",),
    "seasonal": ("anomaly",),
}


def sql(body: str, *views: str) -> str:
    """``body`` after the views it names and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    head = ",\n".join(VIEWS[v] for v in order)
    body = body.strip()
    if not head:
        return body
    return f"WITH RECURSIVE {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH RECURSIVE {head}\n{body}"
