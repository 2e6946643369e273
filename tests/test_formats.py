"""Raster and vector files: round trips and hand-made bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.sources import geotiff, vectors


def test_geotiff_round_trip(spark, tmp_path):
    grid = np.arange(48, dtype=np.float32).reshape(6, 8)
    grid[2, 3] = np.nan
    path = tmp_path / "a.tif"
    path.write_bytes(geotiff.encode_geotiff(grid, (100.0, 200.0), (10.0, 10.0)))
    header = geotiff.read_header(str(path))
    assert (header.width, header.height, header.origin, header.pixel, header.nodata) == (8, 6, (100.0, 200.0), (10.0, 10.0), -9999.0)
    got = {(r["row"], r["col"]): r["value"] for r in geotiff.read_geotiff(spark, f"file://{path}").collect()}
    assert got == {(r, c): float(grid[r, c]) for r in range(6) for c in range(8) if (r, c) != (2, 3)}
    window = geotiff.read_geotiff(spark, str(path), (1, 2, 3, 5)).count()
    assert window == 5


def tiled(grid, size, predictor):
    """A tiled, deflated TIFF of unsigned 16-bit pixels, big end first."""
    blocks = []
    for r in range(0, grid.shape[0], size):
        for c in range(0, grid.shape[1], size):
            block = np.zeros((size, size), ">u2")
            part = grid[r : r + size, c : c + size]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1]
            blocks.append(zlib.compress(block.tobytes()))
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    entries = [(256, 3, (grid.shape[1],)), (257, 3, (grid.shape[0],)), (258, 3, (16,)), (259, 3, (8,)), (277, 3, (1,)), (317, 3, (predictor,)), (322, 3, (size,)), (323, 3, (size,)), (324, 4, offsets), (325, 4, [len(b) for b in blocks]), (339, 3, (1,))]
    table, extra, extra_at = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        raw = struct.pack(">" + {3: "H", 4: "I"}[kind] * len(values), *values)
        value = raw.ljust(4, b"\0")
        if len(raw) > 4:
            value, extra = struct.pack(">I", extra_at + len(extra)), extra + raw
        table += struct.pack(">HHI", tag, kind, len(values)) + value
    return b"MM\0*" + struct.pack(">I", at) + b"".join(blocks) + struct.pack(">H", len(entries)) + table + b"\0" * 4 + extra


@pytest.mark.parametrize("predictor", [1, 2])
def test_tiled_geotiff(spark, tmp_path, predictor):
    grid = (np.arange(70).reshape(7, 10) * 37 % 5000).astype(np.uint16)
    path = tmp_path / "t.tif"
    path.write_bytes(tiled(grid, 4, predictor))
    got = {(r["row"], r["col"]): r["value"] for r in geotiff.read_geotiff(spark, str(path)).collect()}
    assert got == {(r, c): float(grid[r, c]) for r in range(7) for c in range(10)}
    with pytest.raises(ValueError, match="no TIFF"):
        (tmp_path / "x.tif").write_bytes(b"nothing here")
        geotiff.read_header(str(tmp_path / "x.tif"))


def test_written_tiles(spark, tmp_path):
    from sightline.sources.rasters import tiles_from_pixels

    pixels = spark.range(100).select((F.col("id") / 10).cast("long").alias("row"), (F.col("id") % 10).alias("col"), F.col("id").cast("float").alias("v"))
    made = geotiff.write_geotiffs(tiles_from_pixels(pixels, 4, "v"), f"file://{tmp_path}/tiles", 4, (0.0, 0.0), (1.0, 1.0)).collect()
    assert len(made) == 9
    one = next(r for r in made if (r["tile_row"], r["tile_col"]) == (1, 2))
    got = {(r["row"], r["col"]): r["value"] for r in geotiff.read_geotiff(spark, one["path"]).collect()}
    assert got == {(r, c): (4 + r) * 10.0 + 8 + c for r in range(4) for c in range(2)}
    assert geotiff.read_header(one["path"]).origin == (8.0, -4.0)


RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]


def wkb(order, ring):
    return struct.pack(order + "BII", 1 if order == "<" else 0, 3, 1) + struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "2d", *p) for p in ring)


def test_geoparquet(spark, tmp_path):
    from sightline.operators import polygons

    multi = struct.pack("<BII", 1, 6, 2) + wkb("<", RING) + wkb("<", [(x + 10, y) for x, y in RING])
    rows = [(1, bytearray(wkb("<", RING))), (2, bytearray(wkb(">", RING))), (3, bytearray(multi)), (4, None)]
    spark.createDataFrame(rows, "id long, geometry binary").write.parquet(str(tmp_path / "g"))
    got = vectors.read_geoparquet(spark, str(tmp_path / "g"), ["id"])
    areas = {r["id"]: r["area"] for r in got.select("id", F.explode("rings").alias("ring")).select("id", polygons.ring_area(F.col("ring")).alias("area")).groupBy("id").agg(F.sum("area").alias("area")).collect()}
    assert areas == {1: 6.0, 2: 6.0, 3: 12.0}
    with pytest.raises(ValueError, match="no polygon"):
        vectors.wkb_rings(struct.pack("<BI2d", 1, 1, 0.0, 0.0))


def test_shapefile(spark, tmp_path):
    content = struct.pack("<I4d2I", 5, 0, 0, 4, 3, 1, len(RING)) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in RING)
    null = struct.pack("<I", 0)
    body = b"".join(struct.pack(">II", i + 1, len(c) // 2) + c for i, c in enumerate([content, null]))
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, 2, 32 + 32 + 1, 7) + field + b"\r" + b" one   " + b" two   ")
    got = vectors.read_shapefile(spark, str(tmp_path / "s.shp")).orderBy("record").collect()
    assert [r["properties"] for r in got] == [{"NAME": "one"}, {"NAME": "two"}]
    assert [(p["x"], p["y"]) for p in got[0]["rings"][0]] == RING[:-1] and got[1]["rings"] is None
