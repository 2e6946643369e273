"""Vector files as tables of rings: GeoParquet and shapefiles.

A ring is an array of structs (``x, y``), open: the repeated last corner of the formats is dropped.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
# Geometry codes of well-known binary and of shapefiles.
WKB_POLYGON, WKB_MULTIPOLYGON, SHAPE_POLYGONS = 3, 6, (5, 15, 25)


def _open(points: list[tuple[float, ...]]) -> list[dict]:
    if len(points) > 1 and points[0] == points[-1]:
        points = points[:-1]
    return [{"x": p[0], "y": p[1]} for p in points]


def wkb_rings(data: bytes | None) -> list[list[dict]] | None:
    """Rings of a polygon or multipolygon in well-known binary (heights are ignored); null for null."""
    if data is None:
        return None
    at = 0

    def polygon() -> list[list[dict]]:
        nonlocal at
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if kind & 0x20000000:  # a spatial reference follows
            at += 4
        high = bool(kind & 0xC0000000) or kind & 0x0FFFFFFF > 1000
        kind = (kind & 0x0FFFFFFF) % 1000
        count = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if kind == WKB_MULTIPOLYGON:
            return [ring for _ in range(count) for ring in polygon()]
        if kind != WKB_POLYGON:
            raise ValueError(f"geometry {kind} is no polygon")
        rings, width = [], 3 if high else 2
        for _ in range(count):
            n = struct.unpack_from(order + "I", data, at)[0]
            values = struct.unpack_from(f"{order}{n * width}d", data, at + 4)
            at += 4 + 8 * n * width
            rings.append(_open([values[i : i + width] for i in range(0, n * width, width)]))
        return rings

    return polygon()


def read_geoparquet(spark: SparkSession, path: str, columns: list[str], geometry: str = "geometry") -> DataFrame:
    """The given columns and ``rings`` of a GeoParquet table of polygons."""
    df = spark.read.parquet(path).select(*columns, F.col(geometry).alias("_wkb"))

    def decode(batches):
        for batch in batches:
            rings = pa.array([wkb_rings(b) for b in batch.column(len(columns)).to_pylist()], _RINGS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rings], [*columns, "rings"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(decode, f"{schema}{', ' if schema else ''}rings {RINGS}")


def shape_rings(data: bytes) -> list[list[list[dict]] | None]:
    """Rings of every record of a shapefile of polygons; null for null shapes."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = 2 * struct.unpack_from(">I", data, at + 4)[0]
        kind = struct.unpack_from("<I", data, at + 8)[0]
        if kind == 0:
            out.append(None)
        elif kind in SHAPE_POLYGONS:
            parts, points = struct.unpack_from("<II", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", data, at + 52), points]
            values = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            out.append([_open([values[2 * i : 2 * i + 2] for i in range(a, b)]) for a, b in zip(starts, starts[1:], strict=False)])
        else:
            raise ValueError(f"shape {kind} is no polygon")
        at += 8 + size
    return out


def table_rows(data: bytes) -> list[dict[str, str]]:
    """Records of a dBase table, as text; deleted ones are kept, as the shapes are."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at, place = [], 32, 1
    while data[at] != 0x0D:
        name, width = data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]
        fields.append((name, place, place + width))
        place += width
        at += 32
    return [{n: data[head + i * size + a : head + i * size + b].decode("utf-8", "replace").strip() for n, a, b in fields} for i in range(count)]


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """``record, properties (map of text), rings`` of a shapefile (``path`` ends in .shp, its table lies beside it).

    The format holds at most two gigabytes; a file is read by one task.
    """
    stem = path[:-4]
    files = spark.read.format("binaryFile").load([path, f"{stem}.dbf"]).select("path", "content")
    both = files.groupBy().agg(F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shapes"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("table"))

    def decode(batches):
        for batch in batches:
            for shapes, table in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rings, rows = shape_rings(shapes), table_rows(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(rings)), pa.int64()), pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array(rings, _RINGS)], ["record", "properties", "rings"],
                )

    return both.mapInArrow(decode, f"record long, properties map<string,string>, rings {RINGS}")
