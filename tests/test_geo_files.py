"""Files written byte by byte and read back."""

from __future__ import annotations

import json
import struct
import zipfile

import pytest

from tidemark.operators import geo
from tidemark.plans import runs
from tidemark.sources import geo_files, readers

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]


def padded(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def name(s: str) -> bytes:
    return struct.pack(">i", len(s)) + padded(s.encode())


def netcdf(version: int, streamed: bool = False) -> bytes:
    """Two record variables beside the time axis: packed shorts with a fill value, and floats."""
    offset = ">q" if version == 2 else ">i"
    none = struct.pack(">ii", 0, 0)
    short = struct.pack(">ii", 12, 3) + name("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + name("add_offset") + struct.pack(">iid", 6, 1, 10.0) + name("_FillValue") + struct.pack(">ii", 3, 1) + padded(struct.pack(">h", -99))
    shapes = [("time", [0], none, 6, 8), ("lat", [1], none, 5, 8), ("lon", [2], none, 5, 12), ("t2m", [0, 1, 2], short, 3, 12), ("swe", [0, 1, 2], none, 5, 24)]

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", -1 if streamed else 2)
        out += struct.pack(">ii", 10, 3) + b"".join(name(d) + struct.pack(">i", n) for d, n in (("time", 0), ("lat", 2), ("lon", 3))) + none
        out += struct.pack(">ii", 11, len(shapes))
        for (n, dims, attributes, kind, size), begin in zip(shapes, begins, strict=True):
            out += name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + attributes + struct.pack(">ii", kind, size) + struct.pack(offset, begin)
        return out

    at = len(header([0] * 5))
    fixed = struct.pack(">2f", 50.0, 51.0) + struct.pack(">3f", 5.0, 6.0, 7.0)
    first = at + len(fixed)
    body = b""
    for r in range(2):
        body += struct.pack(">d", 100.0 + r) + struct.pack(">6h", *([1, 2, 3, 4, 5, -99] if r else range(6))) + struct.pack(">6f", *[r * 10.0 + i for i in range(6)])
    return header([first, at, at + 8, first + 8, first + 20]) + fixed + body


@pytest.mark.parametrize("version", [1, 2])
def test_netcdf(spark, tmp_path, version):
    (tmp_path / "sub").mkdir()
    (tmp_path / "plain.nc").write_bytes(netcdf(version))
    (tmp_path / "streamed.nc").write_bytes(netcdf(version, streamed=True))
    with zipfile.ZipFile(tmp_path / "sub" / "disguised.nc", "w") as z:
        z.writestr("b.nc", b"not read")
        z.writestr("a.nc", netcdf(version))
        z.writestr("0.txt", b"")
    rows = geo_files.read_netcdf(spark, str(tmp_path)).collect()
    assert len(rows) == 3 * 2 * 2 * 6
    for file in {r.file for r in rows}:
        got = {(r.variable, r.time, r.lat, r.lon): r.value for r in rows if r.file == file}
        assert got["t2m", 100.0, 50.0, 6.0] == 10.5 and got["t2m", 101.0, 51.0, 7.0] is None and got["t2m", 101.0, 51.0, 6.0] == 12.5
        assert got["swe", 101.0, 51.0, 5.0] == 13.0
    with pytest.raises(ValueError, match="HDF5"):
        geo_files._Classic(b"\x89HDF\r\n\x1a\n")


def shapefile(parts, attributes):
    """One polygon record a list of rings, and its table."""
    shp, body = b"", b""
    for i, rings in enumerate(parts):
        points = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        content = struct.pack("<i4d", 5, 0, 0, 0, 0) + struct.pack("<ii", len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", i + 1, len(content) // 2) + content
    body += struct.pack(">ii", len(parts) + 1, 2) + struct.pack("<i", 0)  # a null shape
    shp = struct.pack(">i", 9994) + b"\0" * 96 + body
    fields = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    dbf = bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(attributes), 32 + 32 + 1, 7) + b"\0" * 20 + fields + b"\r" + b"".join(b" " + a.encode().ljust(6) for a in attributes)
    return shp, dbf


def test_shapefiles(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    far = [(x + 9, y) for x, y in SQUARE]
    shp, dbf = shapefile([[SQUARE], [SQUARE, far]], ["one", "", "gone"])
    (tmp_path / "deep" / "er" / "lakes.shp").write_bytes(shp)
    (tmp_path / "deep" / "er" / "lakes.dbf").write_bytes(dbf)
    (tmp_path / "bare.shp").write_bytes(shp)
    rows = geo_files.read_shapefiles(spark, str(tmp_path)).collect()
    got = {(r.file.rsplit("/", 1)[1], r.record, r.part): r for r in rows}
    assert len(rows) == len(got) == 6
    assert got["lakes.shp", 1, 0].attributes == {"NAME": "one"} and got["lakes.shp", 2, 1].attributes == {"NAME": None} and got["bare.shp", 1, 0].attributes == {}
    assert [tuple(p) for p in got["lakes.shp", 2, 1].ring] == far


def test_geojson(spark, tmp_path):
    def feature(kind, coordinates, **p):
        return {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": coordinates}}

    ring = [list(p) for p in SQUARE]
    one, two, dot = feature("Polygon", [ring, ring[:4]], id="a"), feature("MultiPolygon", [[ring], [ring]], id="b"), feature("Point", [1, 2], id="c")
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, (one, two, dot))))
    (tmp_path / "whole.json").write_text(json.dumps({"type": "FeatureCollection", "features": [one, two, dot]}))
    rows = geo_files.read_geojson(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.attributes["id"], r.part) for r in rows) == [(f, i, k) for f in ("lines.json", "whole.json") for i, k in (("a", 0), ("b", 0), ("b", 1))]
    assert all([tuple(p) for p in r.ring] == SQUARE for r in rows)


def test_polygons_pushed_down(spark, tmp_path):
    rows = [(f"p{i}", i % 2, [(x + 10.0 * i, y) for x, y in SQUARE]) for i in range(9)]
    path = str(tmp_path / "polygons")
    table = spark.createDataFrame(rows, f"polygon string, kind int, ring {geo_files.RING}")
    geo_files.write_polygons(table, path)
    found = geo_files.read_polygons(spark, path, (15.0, 1.0, 33.0, 2.0), "kind = 1")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters")[1]
    assert [c for c in ("lon_max", "lon_min", "lat_max", "lat_min", "kind") if f"({c}," not in pushed] == [], pushed
    assert sorted(r.polygon for r in found.collect()) == ["p3"]
    assert geo_files.read_polygons(spark, path).count() == 9
    stations = spark.createDataFrame([(-1.0, 9.0)], "lon double, lat double")
    assert tuple(geo.extent(table, stations, 0.5).first()) == (-1.5, -0.5, 84.5, 9.5)


def test_embedding_params_round_trip(spark, tmp_path):
    rows = [("L1", "WL", 4, 1, 300, None), ('L"2\\', "P", None, 1, 3, "too_short"), ("L1", "P", 2, 1, 9, None)]
    path = str(tmp_path / "params")
    readers.write_embedding_params(spark.createDataFrame(rows, "entity string, variable string, E int, tau int, n_obs int, status string"), path)
    got = [tuple(r) for r in readers.read_embedding_params(spark, path).select("entity", "variable", "E", "tau", "n_obs", "status").collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_gate_and_steps(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "there"))
    runs.require_inputs(spark, {"there": ("parquet", str(tmp_path / "there"))})
    with pytest.raises(FileNotFoundError, match="gone"):
        runs.require_inputs(spark, {"there": ("parquet", str(tmp_path / "there")), "gone": ("parquet", str(tmp_path / "gone"))})
    done = []

    def broken():
        raise ValueError("no data\nmore")

    status = runs.run_steps(spark, {"a": lambda: done.append(1), "b": broken, "c": lambda: done.append(2)})
    assert [(r.step, r.status, r.error) for r in status.collect()] == [("a", "OK", None), ("b", "failed", "no data"), ("c", "skipped", None)]
    assert done == [1]
