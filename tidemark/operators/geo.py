"""Geometry on ring arrays: containment, grids and spatial means.

A polygon is ``array<struct<lon: double, lat: double>>``, its closed outer ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import upstream


def in_ring(lon, lat, ring) -> F.Column:
    """Ray casting: an odd number of edges cross the ray to the east."""

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, i + 1)
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"])
        return F.when(straddles, lon < at).otherwise(False)

    return F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 2), crosses)) % 2 == 1


def bounds(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Bounding box columns, which filters push down to."""

    def edge(f, part):
        return f(F.transform(ring, lambda p: p[part]))

    return polygons.withColumns({"lon_min": edge(F.array_min, "lon"), "lon_max": edge(F.array_max, "lon"), "lat_min": edge(F.array_min, "lat"), "lat_max": edge(F.array_max, "lat")})


def _covering(polygons: DataFrame, margin: float, cell: float) -> DataFrame:
    """Polygons by every coarse cell ``(_ci, _cj)`` that their box, ``margin`` wider, meets: an equality key for points."""

    def line(low: str, high: str) -> F.Column:
        return F.explode(F.sequence(F.floor((F.col(low) - margin) / cell), F.floor((F.col(high) + margin) / cell)))

    return bounds(polygons).withColumn("_ci", line("lon_min", "lon_max")).withColumn("_cj", line("lat_min", "lat_max"))


def _celled(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumns({"_ci": F.floor(F.col("lon") / cell), "_cj": F.floor(F.col("lat") / cell)})


def containing(points: DataFrame, polygons: DataFrame, key: str = "polygon", cell: float = 1.0) -> DataFrame:
    """(point columns, polygon) of every containing polygon: by coarse cell, then box, then ring."""
    inside = F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
    met = _celled(points, cell).join(_covering(polygons, 0.0, cell), ["_ci", "_cj"])
    return met.filter(inside).filter(in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).select(*points.columns, key)


def distance(lon, lat, ring) -> F.Column:
    """From a point to the nearest place of a ring's edges, in degrees."""

    def to_edge(i):
        a, b = F.get(ring, i), F.get(ring, i + 1)
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / length))).otherwise(0.0)
        x, y = lon - (a["lon"] + t * dx), lat - (a["lat"] + t * dy)
        return F.sqrt(x * x + y * y)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), to_edge))


def resolve(points: DataFrame, polygons: DataFrame, point: str = "point", key: str = "polygon", limit: float = 1.0, cell: float = 1.0, where: str | None = None) -> DataFrame:
    """The containing polygon of a point (smallest key), else the nearest one within ``limit``; ``where`` filters polygons by attributes first."""
    polygons = polygons.filter(where) if where else polygons
    inside = containing(points, polygons, key, cell).groupBy(point).agg(F.min(key).alias("inside"))
    met = _celled(points, cell).join(_covering(polygons, limit, cell), ["_ci", "_cj"])
    near = met.withColumn("_d", distance(F.col("lon"), F.col("lat"), F.col("ring"))).filter(F.col("_d") <= limit)
    nearest = near.groupBy(point).agg(F.min(F.struct("_d", key)).alias("b")).select(point, F.col(f"b.{key}").alias("nearest"))
    return points.join(inside, point, "left").join(nearest, point, "left").select(point, F.coalesce("inside", "nearest").alias(key), F.col("inside").isNotNull().alias("contains"))


def meets_box(ring, x0, y0, x1, y1) -> F.Column:
    """Whether a polygon and a box have a point in common, edges included."""

    def edge(i):
        a, b = F.get(ring, i), F.get(ring, i + 1)
        apart = (F.greatest(a["lon"], b["lon"]) < x0) | (F.least(a["lon"], b["lon"]) > x1) | (F.greatest(a["lat"], b["lat"]) < y0) | (F.least(a["lat"], b["lat"]) > y1)
        sides = [(b["lon"] - a["lon"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lon"]) for x in (x0, x1) for y in (y0, y1)]
        return ~apart & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(F.sequence(F.lit(0), F.size(ring) - 2), edge) | in_ring((x0 + x1) / 2, (y0 + y1) / 2, ring)


def grid_cells(polygons: DataFrame, key: str = "polygon", step: float = 1.0, buffer: float = 0.0) -> DataFrame:
    """Centres of the cells of a regular grid that the polygon meets, among those of its box with a buffer."""
    box = bounds(polygons)

    def line(low, high):
        return F.explode(F.sequence(F.floor((F.col(low) - buffer) / step), F.ceil((F.col(high) + buffer) / step) - 1))

    cells = box.withColumn("_i", line("lon_min", "lon_max")).withColumn("_j", line("lat_min", "lat_max"))
    x, y = F.col("_i") * step, F.col("_j") * step
    cells = cells.withColumns({"lon": (F.col("_i") + 0.5) * step, "lat": (F.col("_j") + 0.5) * step})
    return cells.filter(meets_box(F.col("ring"), x, y, x + step, y + step)).select(key, "lon", "lat")


def basin_cells(basins: DataFrame, outlets: DataFrame, step: float = 1.0, buffer: float = 0.0, node: str = "node", down: str = "down") -> DataFrame:
    """Cells of all basins upstream of the one that holds the outlet point: containment, closure and grid in one."""
    held = containing(outlets, basins.withColumnRenamed(node, "polygon")).agg(F.min("polygon")).first()[0]
    if held is None:
        raise ValueError("the outlet lies in no basin")
    return grid_cells(basins.join(upstream(basins, held, node, down), node, "left_semi"), node, step, buffer).select("lon", "lat").distinct()


def masked_mean(cube: DataFrame, cells: DataFrame, step: float, key: str = "polygon") -> DataFrame:
    """Mean by time over the grid values nearest to the cells; the nearest grid point is a rounded-key join."""
    i, j = F.floor(F.col("lon") / step), F.floor(F.col("lat") / step)
    placed = cells.select(key, i.alias("_i"), j.alias("_j")).distinct()
    return cube.withColumns({"_i": i, "_j": j}).join(placed, ["_i", "_j"]).groupBy(key, "time").agg(F.avg("value").alias("value"), F.count("*").alias("n_cells"))


def request_box(*cells: DataFrame, padding: float = 0.1) -> DataFrame:
    """North, west, south and east of several cell sets, padded."""
    every = cells[0].select("lon", "lat")
    for c in cells[1:]:
        every = every.unionByName(c.select("lon", "lat"))
    return every.agg((F.max("lat") + padding).alias("north"), (F.min("lon") - padding).alias("west"), (F.min("lat") - padding).alias("south"), (F.max("lon") + padding).alias("east"))


def extent(polygons: DataFrame, stations: DataFrame, padding: float = 0.1) -> DataFrame:
    """West, south, east and north of all polygons and stations, padded: the frame of a map panel."""
    box = bounds(polygons).select("lon_min", "lat_min", "lon_max", "lat_max")
    every = box.unionByName(stations.select(F.col("lon").alias("lon_min"), F.col("lat").alias("lat_min"), F.col("lon").alias("lon_max"), F.col("lat").alias("lat_max")))
    return every.agg((F.min("lon_min") - padding).alias("west"), (F.min("lat_min") - padding).alias("south"), (F.max("lon_max") + padding).alias("east"), (F.max("lat_max") + padding).alias("north"))
