"""Geometry queries on a square, a triangle and a notched polygon."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import geo as G
from tidemark.queries.base import Query
from tidemark.sources import tables as T

# Closed rings (lon, lat).
RINGS = {
    "square": ((1, 1), (6, 1), (6, 6), (1, 6), (1, 1)),
    "triangle": ((4, 4), (10, 4), (4, 10), (4, 4)),
    "notch": ((0, 0), (10, 0), (10, 10), (5, 2.5), (0, 10), (0, 0)),
}


def polygons(spark):
    rows = [(name, [(float(x), float(y)) for x, y in ring]) for name, ring in RINGS.items()]
    return spark.createDataFrame(rows, "polygon string, ring array<struct<lon:double,lat:double>>")


def points(spark, sf):
    c = T.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("point"), ((F.col("c_custkey") % 97) / 9.0).alias("lon"), ((F.col("c_custkey") % 89) / 8.0).alias("lat"))


def _inside(spark, sf):
    return G.containing(points(spark, sf), polygons(spark)).select("point", "polygon")


def _resolve(spark, sf):
    return G.resolve(points(spark, sf), polygons(spark), limit=1.0)


def _cells(spark, sf):
    return G.grid_cells(polygons(spark), step=0.5, buffer=0.15).select("polygon", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


def cube(spark, sf):
    p = T.table(spark, sf, "part")
    return p.select((F.col("p_partkey") % 23 / 2.0).alias("lon"), (F.col("p_partkey") % 21 / 2.0).alias("lat"), F.col("p_size").alias("time"), F.col("p_retailprice").alias("value"))


def _mean(spark, sf):
    m = G.masked_mean(cube(spark, sf), G.grid_cells(polygons(spark), step=0.5), 0.5)
    return m.select("polygon", F.col("time").cast("long").alias("time"), F.round("value", 8).alias("value"), "n_cells")


def _box(spark, sf):
    p = polygons(spark)
    b = G.request_box(G.grid_cells(p.filter("polygon = 'square'"), step=0.5), G.grid_cells(p.filter("polygon = 'triangle'"), step=0.5))
    return b.select(*[F.round(c, 4).alias(c) for c in b.columns])


def _extent(spark, sf):
    e = G.extent(polygons(spark), points(spark, sf), padding=0.5)
    return e.select(*[F.round(c, 4).alias(c) for c in e.columns])


_EDGES = "e AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for n, r in RINGS.items() for a, b in zip(r, r[1:], strict=False)
) + ") v(polygon, x1, y1, x2, y2)), b AS (SELECT polygon, min(x1) AS x0, max(x1) AS x9, min(y1) AS y0, max(y1) AS y9 FROM e GROUP BY ALL)"
_PTS = "p AS (SELECT c_custkey AS point, (c_custkey % 97) / 9.0::DOUBLE AS lon, (c_custkey % 89) / 8.0::DOUBLE AS lat FROM customer)"
_HIT = "(y1 > lat) <> (y2 > lat) AND lon < x1 + (x2 - x1) * (lat - y1) / (y2 - y1)"


def _side(x: str, y: str) -> str:
    return f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)"


def _cells_sql(step: float, buffer: float) -> str:
    return f"""g AS (SELECT polygon, (i + 0.5::DOUBLE) * {step} AS lon, (j + 0.5::DOUBLE) * {step} AS lat FROM b,
            (SELECT unnest(range(-4, 40)) AS i), (SELECT unnest(range(-4, 40)) AS j)
            WHERE i BETWEEN floor((x0 - {buffer}) / {step}) AND ceil((x9 + {buffer}) / {step}) - 1 AND j BETWEEN floor((y0 - {buffer}) / {step}) AND ceil((y9 + {buffer}) / {step}) - 1),
        s AS (SELECT *, lon - {step / 2}::DOUBLE AS cx, lat - {step / 2}::DOUBLE AS cy FROM g JOIN e USING (polygon)),
        m AS (SELECT *, {_side('cx', 'cy')} AS s1, {_side(f'cx + {step}', 'cy')} AS s2, {_side('cx', f'cy + {step}')} AS s3, {_side(f'cx + {step}', f'cy + {step}')} AS s4 FROM s),
        c AS (SELECT polygon, lon, lat FROM m GROUP BY ALL HAVING count(*) FILTER ({_HIT}) % 2 = 1
            OR bool_or(greatest(x1, x2) >= cx AND least(x1, x2) <= cx + {step} AND greatest(y1, y2) >= cy AND least(y1, y2) <= cy + {step} AND least(s1, s2, s3, s4) <= 0 AND greatest(s1, s2, s3, s4) >= 0))"""


QUERIES = {
    "point_in_polygon": Query(_inside, f"WITH {_EDGES}, {_PTS} SELECT point, polygon FROM p, e GROUP BY ALL HAVING count(*) FILTER ({_HIT}) % 2 = 1"),
    "resolve_polygon": Query(_resolve, f"""WITH {_EDGES}, {_PTS},
        i AS (SELECT point, min(polygon) AS inside FROM (SELECT point, polygon FROM p, e GROUP BY ALL HAVING count(*) FILTER ({_HIT}) % 2 = 1) GROUP BY ALL),
        t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM p, e),
        d AS (SELECT point, polygon, min(sqrt(power(lon - (x1 + t * (x2 - x1)), 2) + power(lat - (y1 + t * (y2 - y1)), 2))) AS d FROM t GROUP BY ALL),
        n AS (SELECT point, polygon AS nearest FROM d WHERE d <= 1 QUALIFY row_number() OVER (PARTITION BY point ORDER BY d, polygon) = 1)
        SELECT point, coalesce(inside, nearest) AS polygon, inside IS NOT NULL AS contains FROM p LEFT JOIN i USING (point) LEFT JOIN n USING (point)"""),
    "grid_cells": Query(_cells, f"WITH {_EDGES}, {_cells_sql(0.5, 0.15)} SELECT polygon, round(lon, 4) AS lon, round(lat, 4) AS lat FROM c"),
    "grid_mask_mean": Query(_mean, f"""WITH {_EDGES}, {_cells_sql(0.5, 0)}, q AS (SELECT (p_partkey % 23) / 2.0::DOUBLE AS lon, (p_partkey % 21) / 2.0::DOUBLE AS lat, p_size AS time, p_retailprice AS value FROM part)
        SELECT polygon, time::BIGINT AS time, round(avg(value), 8) AS value, count(*) AS n_cells FROM q JOIN (SELECT DISTINCT polygon, floor(lon / 0.5) AS i, floor(lat / 0.5) AS j FROM c) k ON floor(q.lon / 0.5) = i AND floor(q.lat / 0.5) = j GROUP BY ALL"""),
    "request_box": Query(_box, f"""WITH {_EDGES}, {_cells_sql(0.5, 0)} SELECT round(max(lat) + 0.1::DOUBLE, 4) AS north, round(min(lon) - 0.1::DOUBLE, 4) AS west, round(min(lat) - 0.1::DOUBLE, 4) AS south, round(max(lon) + 0.1::DOUBLE, 4) AS east
        FROM c WHERE polygon <> 'notch'"""),
    "panel_extent": Query(_extent, f"""WITH {_EDGES}, {_PTS}, u AS (SELECT x0, y0, x9, y9 FROM b UNION ALL SELECT lon, lat, lon, lat FROM p)
        SELECT round(min(x0) - 0.5::DOUBLE, 4) AS west, round(min(y0) - 0.5::DOUBLE, 4) AS south, round(max(x9) + 0.5::DOUBLE, 4) AS east, round(max(y9) + 0.5::DOUBLE, 4) AS north FROM u"""),
}
