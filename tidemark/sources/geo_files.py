"""Grids and polygons from files: NetCDF (classic format), shapefiles, GeoJSON lines, and Parquet rings with box columns.

Binary files are decoded by the task that reads them, one file at a time, and
leave it in batches of bounded size. NetCDF-4 (HDF5) has no decoder here and is
refused by name.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.geo import bounds

RING = "array<struct<lon:double,lat:double>>"
BATCH = 1 << 16

# Fixed values of the classic NetCDF format: big-endian types by code.
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
NC_DIMENSIONS, NC_VARIABLES, NC_ATTRIBUTES = 10, 11, 12
ZIP_MAGIC, HDF_MAGIC, CDF_MAGIC = b"PK\x03\x04", b"\x89HDF", b"CDF"
SHAPE_POLYGONS = (5, 15, 25)


def unzipped(content: bytes) -> bytes:
    """The content, or of a zip (told by its magic, whatever the name) the first ``*.nc`` by name."""
    if not content.startswith(ZIP_MAGIC):
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(n for n in z.namelist() if n.endswith(".nc"))
        if not names:
            raise ValueError("no .nc file in the archive")
        return z.read(names[0])


class _Classic:
    """Header of a classic NetCDF file; ``values`` reads one slice of a variable's first dimension."""

    def __init__(self, content: bytes):
        if content.startswith(HDF_MAGIC):
            raise ValueError("NetCDF-4 (HDF5) is not read; convert the grid to classic NetCDF or Parquet")
        if not content.startswith(CDF_MAGIC) or content[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.data, self.at, self.wide = content, 4, content[3] == 2
        records = self._int()
        self.dims = self._list(NC_DIMENSIONS, lambda: (self._name(), self._int()))
        self._list(NC_ATTRIBUTES, self._attribute)
        self.variables = dict(self._list(NC_VARIABLES, self._variable))
        moving = [v for v in self.variables.values() if v["record"]]
        # A lone record variable is packed without padding.
        self.stride = moving[0]["bytes"] if len(moving) == 1 else sum(-(-v["bytes"] // 4) * 4 for v in moving)
        if records < 0:  # written as a stream: as many records as there are bytes for
            records = (len(content) - min(v["begin"] for v in moving)) // self.stride if moving and self.stride else 0
        self.records = records

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.data, self.at - 4)[0]

    def _name(self) -> str:
        n = self._int()
        name = self.data[self.at : self.at + n].decode("utf-8")
        self.at += -(-n // 4) * 4
        return name

    def _list(self, tag: int, read) -> list:
        found, n = self._int(), self._int()
        if found not in (0, tag):
            raise ValueError("broken NetCDF header")
        return [read() for _ in range(n)]

    def _attribute(self):
        name, kind, n = self._name(), np.dtype(NC_TYPES[self._int()]), self._int()
        values = np.frombuffer(self.data, kind, n, self.at)
        self.at += -(-n * kind.itemsize // 4) * 4
        return name, values

    def _variable(self):
        name = self._name()
        dims = [self._int() for _ in range(self._int())]
        attributes = dict(self._list(NC_ATTRIBUTES, self._attribute))
        kind = np.dtype(NC_TYPES[self._int()])
        self._int()  # the stated size, which wraps for large variables
        self.at += 8 if self.wide else 4
        begin = struct.unpack_from(">q" if self.wide else ">i", self.data, self.at - (8 if self.wide else 4))[0]
        record = bool(dims) and self.dims[dims[0]][1] == 0
        inner = [self.dims[d][1] for d in (dims[1:] if record else dims)]
        return name, {"dims": [self.dims[d][0] for d in dims], "shape": inner, "kind": kind, "begin": begin, "record": record, "attributes": attributes, "bytes": int(np.prod(inner, dtype=np.int64)) * kind.itemsize}

    def length(self, name: str) -> int:
        v = self.variables[name]
        return self.records if v["record"] else v["shape"][0]

    def values(self, name: str, i: int) -> np.ndarray:
        """Slice ``i`` as doubles: fill values to NaN, then scale and offset."""
        v = self.variables[name]
        shape = v["shape"] if v["record"] else v["shape"][1:]
        n = int(np.prod(shape, dtype=np.int64))
        raw = np.frombuffer(self.data, v["kind"], n, v["begin"] + i * (self.stride if v["record"] else n * v["kind"].itemsize)).reshape(shape)
        out = raw.astype(float)
        for a in ("_FillValue", "missing_value"):
            if a in v["attributes"]:
                out = np.where(raw == v["attributes"][a][0], np.nan, out)
        scale, offset = (float(v["attributes"][a][0]) if a in v["attributes"] else d for a, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + offset

    def axis(self, name: str) -> np.ndarray:
        return np.array([float(self.values(name, i)) for i in range(self.length(name))])


def _grids(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, content in zip(part["path"], part["content"], strict=True):
            f = _Classic(unzipped(content))
            for name, v in f.variables.items():
                if len(v["dims"]) != 3 or not all(d in f.variables for d in v["dims"]):
                    continue
                times, lats, lons = (f.axis(d) for d in v["dims"])
                lat, lon = np.repeat(lats, len(lons)), np.tile(lons, len(lats))
                for i, t in enumerate(times):
                    flat = f.values(name, i).ravel()
                    for k in range(0, len(flat), BATCH):
                        s = slice(k, k + BATCH)
                        yield pd.DataFrame({"file": path, "variable": name, "time": t, "lat": lat[s], "lon": lon[s], "value": flat[s]})


def read_netcdf(spark: SparkSession, path: str) -> DataFrame:
    """``(file, variable, time, lat, lon, value)`` of every variable over (time, latitude, longitude); fill values are NULL.

    ``time`` is in the file's own unit. Zips in disguise are opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    out = files.mapInPandas(_grids, "file string, variable string, time double, lat double, lon double, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _records(dbf: bytes | None) -> Iterator[dict[str, str | None]]:
    """Rows of a dBASE table as text, blank cells as None; deleted rows keep their place."""
    if not dbf:
        return
    n, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while at < head - 1 and dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    for i in range(n):
        at, row = head + i * width + 1, {}
        for name, size in fields:
            row[name] = dbf[at : at + size].decode("utf-8", "replace").strip(" \0") or None
            at += size
        yield row


def _shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "record", "part", "ring", "attributes"]
    for part in parts:
        for path, shp, dbf in zip(part["path"], part["shp"], part["dbf"], strict=True):
            rows, points, at, attributes = [], 0, 100, _records(dbf)
            while at + 8 <= len(shp):
                number, words = struct.unpack_from(">ii", shp, at)
                kind = struct.unpack_from("<i", shp, at + 8)[0]
                row = next(attributes, {})
                if kind in SHAPE_POLYGONS:
                    n_parts, n_points = struct.unpack_from("<ii", shp, at + 44)
                    starts = [*struct.unpack_from(f"<{n_parts}i", shp, at + 52), n_points]
                    xy = np.frombuffer(shp, "<f8", 2 * n_points, at + 52 + 4 * n_parts).reshape(-1, 2)
                    for k in range(n_parts):
                        ring = [{"lon": float(x), "lat": float(y)} for x, y in xy[starts[k] : starts[k + 1]]]
                        rows.append((path, number, k, ring, row))
                        points += len(ring)
                elif kind:
                    raise ValueError(f"shape type {kind} is no polygon")
                at += 8 + 2 * words
                if points >= BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, points = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, part, ring, attributes)`` of every polygon part below a folder; attributes come from the ``.dbf`` beside it, if any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{shp,dbf}").load(path)
    stem = files.select(F.regexp_replace("path", r"\.\w+$", "").alias("stem"), F.lower(F.substring_index("path", ".", -1)).alias("kind"), "path", "content")
    shp = stem.filter("kind = 'shp'").select("stem", "path", F.col("content").alias("shp"))
    dbf = stem.filter("kind = 'dbf'").select("stem", F.col("content").alias("dbf"))
    pairs = shp.join(dbf, "stem", "left").select("path", "shp", "dbf")
    return pairs.mapInPandas(_shapes, f"file string, record int, part int, ring {RING}, attributes map<string,string>")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``(file, part, ring, attributes)`` of the outer rings of polygon features, one feature a line or a FeatureCollection a file's line."""
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim(F.col("value"), F.lit(" ,\r")).alias("line")).filter(F.startswith("line", F.lit("{")))
    several = F.from_json("line", f"struct<features:array<{feature}>>")["features"]
    features = lines.select("file", F.explode(F.coalesce(several, F.array(F.from_json("line", feature)))).alias("f")).select("file", "f.*")
    text = F.col("geometry.coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    shapes = F.when(F.col("geometry.type") == "Polygon", F.array(one)).when(F.col("geometry.type") == "MultiPolygon", many)
    rings = features.select("file", F.posexplode(shapes).alias("part", "shape"), F.col("properties").alias("attributes"))
    ring = F.transform(F.get("shape", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return rings.select("file", "part", ring.alias("ring"), "attributes")


def write_polygons(polygons: DataFrame, path: str) -> None:
    """Rings with box columns, in order of place so that a file's statistics are narrow."""
    bounds(polygons).repartitionByRange("lon_min", "lat_min").sortWithinPartitions("lon_min", "lat_min").write.mode("overwrite").parquet(path)


def read_polygons(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, where: str | None = None) -> DataFrame:
    """Polygons whose box meets ``(west, south, east, north)`` and whose attributes pass ``where``; the scan skips the rest."""
    found = spark.read.parquet(path)
    if box:
        west, south, east, north = box
        found = found.filter((F.col("lon_max") >= west) & (F.col("lon_min") <= east) & (F.col("lat_max") >= south) & (F.col("lat_min") <= north))
    return found.filter(where) if where else found
