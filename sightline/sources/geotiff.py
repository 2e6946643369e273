"""GeoTIFF rasters: the header is read on the driver, the blocks by the tasks.

Single-band rasters in strips or tiles, uncompressed or deflated, with or without horizontal
differences.  A window prunes blocks before any is read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# TIFF tags, field types (code -> struct letter) and sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
SAMPLE_FORMATS = {1: "u", 2: "i", 3: "f"}


def open_file(uri: str):
    """Random access to ``uri`` (a path, or file, s3, gs or hdfs)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    system, path = (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


@dataclass(frozen=True)
class Header:
    """Shape, block layout and placement of a raster."""

    width: int
    height: int
    dtype: str
    compression: int
    predictor: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    origin: tuple[float, float]
    pixel: tuple[float, float]
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])


def read_header(uri: str) -> Header:
    """Header of a GeoTIFF, by a few small reads."""
    with open_file(uri) as file:
        head = file.read_at(8, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{uri} is no TIFF file")
        at = struct.unpack(order + "I", head[4:8])[0]
        count = struct.unpack(order + "H", file.read_at(2, at))[0]
        raw = file.read_at(12 * count, at + 2)
        tags = {}
        for i in range(count):
            tag, kind, n, value = struct.unpack(order + "HHI4s", raw[12 * i : 12 * i + 12])
            if kind not in FIELD_TYPES:
                continue
            letter = FIELD_TYPES[kind]
            size = struct.calcsize("=" + letter) * n
            data = value[:size] if size <= 4 else file.read_at(size, struct.unpack(order + "I", value)[0])
            tags[tag] = data.rstrip(b"\0").decode() if letter == "s" else struct.unpack(order + letter * n, data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError(f"{uri} has several bands")
    if one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"{uri} has a compression that is not read")
    tiled = TILES in tags
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, 2**32 - 1), one(HEIGHT, 0)), one(WIDTH, 0))
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0)), tags.get(TIE_POINT, (0.0,) * 6)
    nodata = float(tags[NODATA]) if tags.get(NODATA, "").strip() else None
    return Header(
        one(WIDTH, 0), one(HEIGHT, 0), f"{order}{SAMPLE_FORMATS[one(FORMAT, 1)]}{one(BITS, 8) // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1), block,
        tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]), (scale[0], scale[1]), nodata,
    )


def decode_block(header: Header, index: int, data: bytes) -> tuple[int, int, np.ndarray]:
    """First row, first column and pixels of a block, cut to the raster."""
    rows, cols = header.block
    row, col = index // header.across * rows, index % header.across * cols
    raw = zlib.decompress(data) if header.compression != 1 else data
    grid = np.frombuffer(raw, header.dtype)
    grid = grid[: len(grid) // cols * cols].reshape(-1, cols)
    if header.predictor == 2:
        grid = np.cumsum(grid, axis=1, dtype=grid.dtype)
    return row, col, grid[: header.height - row, : header.width - col]


def read_geotiff(spark: SparkSession, uri: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels (``row, col, value``; no-data and NaN left out) of a raster, of a window (row0, col0, row1, col1) if given."""
    header = read_header(uri)
    r0, c0, r1, c1 = window or (0, 0, header.height, header.width)
    rows, cols = header.block
    wanted = [i for i in range(len(header.offsets)) if (i // header.across * rows < r1 and (i // header.across + 1) * rows > r0 and i % header.across * cols < c1 and (i % header.across + 1) * cols > c0)]
    blocks = spark.createDataFrame([(i,) for i in wanted], "block int").repartition(max(1, min(len(wanted), 10_000)))

    def read(batches):
        with open_file(uri) as file:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    row, col, grid = decode_block(header, i, file.read_at(header.sizes[i], header.offsets[i]))
                    ok = ~np.isnan(grid) if grid.dtype.kind == "f" else np.ones(grid.shape, bool)
                    if header.nodata is not None:
                        ok &= grid != header.nodata
                    r, c = np.nonzero(ok)
                    inside = (r + row >= r0) & (r + row < r1) & (c + col >= c0) & (c + col < c1)
                    r, c = r[inside], c[inside]
                    yield pa.RecordBatch.from_arrays([pa.array(r + row, pa.int64()), pa.array(c + col, pa.int64()), pa.array(grid[r, c].astype(np.float64))], ["row", "col", "value"])

    return blocks.mapInArrow(read, "row long, col long, value double")


def encode_geotiff(grid: np.ndarray, origin: tuple[float, float], pixel: tuple[float, float], nodata: float = -9999.0) -> bytes:
    """A deflated one-strip GeoTIFF of float32 pixels; NaN becomes ``nodata``."""
    data = zlib.compress(np.where(np.isnan(grid), nodata, grid).astype("<f4").tobytes())
    text = f"{nodata:g}".encode() + b"\0"
    entries = [
        (WIDTH, 4, (grid.shape[1],)), (HEIGHT, 4, (grid.shape[0],)), (BITS, 3, (32,)), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (STRIPS, 4, (8,)), (SAMPLES, 3, (1,)),
        (STRIP_ROWS, 4, (grid.shape[0],)), (STRIP_BYTES, 4, (len(data),)), (FORMAT, 3, (3,)), (PIXEL_SCALE, 12, (*pixel, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, *origin, 0.0)), (NODATA, 2, text),
    ]
    start = 8 + len(data) + len(data) % 2
    extra_at, table, extra = start + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack("<" + FIELD_TYPES[kind] * len(values), *values)
        if len(raw) > 4:
            value, extra = struct.pack("<I", extra_at + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
        else:
            value = raw.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, kind, len(values)) + value
    return b"II*\0" + struct.pack("<I", start) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(entries)) + table + b"\0" * 4 + extra


def write_geotiffs(tiles: DataFrame, folder: str, size: int, origin: tuple[float, float], pixel: tuple[float, float]) -> DataFrame:
    """Write each tile (``tile_row, tile_col, data``: float32 squares of ``size``) as a GeoTIFF; returns ``path, tile_row, tile_col``.

    The tasks write under temporary names and move the files into place.
    """
    from pyspark import TaskContext

    def write(batches):
        from pyarrow import fs

        base = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
        system, base = (fs.LocalFileSystem(), base) if "://" not in base else fs.FileSystem.from_uri(base)
        system.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            paths = []
            for r, c, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                grid = np.frombuffer(data, np.float32).reshape(size, size)
                name = f"{base}/tile_{r}_{c}.tif"
                with system.open_output_stream(f"{name}.{attempt}") as out:
                    out.write(encode_geotiff(grid, (origin[0] + c * size * pixel[0], origin[1] - r * size * pixel[1]), pixel))
                system.move(f"{name}.{attempt}", name)
                paths.append(f"{folder}/tile_{r}_{c}.tif")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), batch.column(0), batch.column(1)], ["path", "tile_row", "tile_col"])

    return tiles.select("tile_row", "tile_col", "data").mapInArrow(write, "path string, tile_row long, tile_col long")
