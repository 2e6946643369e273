"""Rasters and vectors as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tiles_from_pixels(pixels: DataFrame, size: int, value: str) -> DataFrame:
    """Pixel table (``row, col, value``) as tiles: ``tile_row, tile_col, data`` - ``size`` x ``size`` float32, NaN where missing."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((size, size), np.nan, np.float32)
        grid[pdf["row"].to_numpy() % size, pdf["col"].to_numpy() % size] = pdf[value].to_numpy()
        return pd.DataFrame({"tile_row": [pdf["tile_row"].iloc[0]], "tile_col": [pdf["tile_col"].iloc[0]], "data": [grid.tobytes()]})

    placed = pixels.withColumns({"tile_row": F.floor(F.col("row") / size), "tile_col": F.floor(F.col("col") / size)})
    return placed.groupBy("tile_row", "tile_col").applyInPandas(pack, "tile_row long, tile_col long, data binary")


def pixels_from_tiles(tiles: DataFrame, size: int, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels (``row, col, value``; missing ones left out) of tiles, of a window (row0, col0, row1, col1) if given.

    The window prunes tiles before any is decoded.
    """
    if window:
        r0, c0, r1, c1 = window
        tiles = tiles.where(F.col("tile_row").between(r0 // size, (r1 - 1) // size) & F.col("tile_col").between(c0 // size, (c1 - 1) // size))

    def decode(batches):
        for batch in batches:
            for tr, tc, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                grid = np.frombuffer(data, np.float32).reshape(size, size)
                r, c = np.nonzero(~np.isnan(grid))
                yield pa.RecordBatch.from_arrays([pa.array(r + tr * size), pa.array(c + tc * size), pa.array(grid[r, c].astype(np.float64))], ["row", "col", "value"])

    out = tiles.select("tile_row", "tile_col", "data").mapInArrow(decode, "row long, col long, value double")
    if window:
        out = out.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return out


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (``row, col, value``) of Arc/Info ASCII grids; one row of text is one row of pixels."""
    lines = spark.read.text(path, wholetext=True)
    text = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    header = F.map_from_entries(F.transform(F.slice(text, 1, 6), lambda s: F.struct(F.lower(F.split(s, r"\s+")[0]), F.split(s, r"\s+")[1])))
    body = lines.select(header.alias("h"), F.posexplode(F.slice(text, 7, 2_000_000_000)).alias("row", "line"))
    cells = body.select("h", F.col("row").cast("long"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    return cells.select("row", F.col("col").cast("long"), F.col("v").cast("double").alias("value")).where(F.col("value") != F.coalesce(F.try_element_at("h", F.lit("nodata_value")).cast("double"), F.lit(-9999.0)))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON collection: the given properties (a DDL list) and ``rings``, arrays of (x, y) arrays."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.col("f.geometry.coordinates").alias("rings"))


def read_buildings(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Building records (``xmin, ymin, xmax, ymax, height``) that meet a box; negative heights are missing."""
    x0, y0, x1, y1 = box
    df = spark.read.parquet(path)
    met = (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)
    return df.where(met).withColumn("height", F.when(F.col("height") >= 0, F.col("height")))


def point_in_ring(x, y, ring) -> F.Column:
    """Whether a point is inside a ring (array of (x, y) arrays), by the parity of crossings."""
    after = F.concat(F.slice(ring, 2, 2_000_000_000), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("a"), after.alias("b"))

    def crosses(e):
        (ax, ay), (bx, by) = ((e[k][0], e[k][1]) for k in ("a", "b"))
        return ((ay > y) != (by > y)) & (x < F.coalesce(F.try_divide((bx - ax) * (y - ay), by - ay), F.lit(0.0)) + ax)

    return F.pmod(F.size(F.filter(edges, crosses)), F.lit(2)) == 1
