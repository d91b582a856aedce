"""GeoTIFF files without further libraries: tiled, deflated, in the 64-bit form of the format.

Tiles are laid out and compressed by the executors; the driver only appends them to the file, a
partition at a time, and writes the directory last. Tiles without pixels take no space.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 512
# fixed values: tags and types of the format, and keys of the coordinate system
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _PHOTOMETRIC, _SAMPLES, _PLANAR = 256, 257, 258, 259, 262, 277, 284
_TILE_WIDTH, _TILE_LENGTH, _OFFSETS, _COUNTS, _FORMAT, _TRANSFORM, _KEYS, _NODATA = 322, 323, 324, 325, 339, 34264, 34735, 42113
_TYPES = {2: "c", 3: "H", 4: "I", 12: "d", 16: "Q"}
_MODEL, _RASTER, _GEOGRAPHIC, _PROJECTED = 1024, 1025, 2048, 3072


@dataclass(frozen=True)
class Grid:
    """A regular grid: axes as (first centre, signed step, count), and the code of its coordinates."""

    y: tuple[float, float, int]
    x: tuple[float, float, int]
    epsg: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.y[2], self.x[2]

    def part(self, r0: int, r1: int, c0: int, c1: int) -> Grid:
        """The grid of rows r0 to r1 and columns c0 to c1, ends excluded."""
        return Grid((self.y[0] + r0 * self.y[1], self.y[1], r1 - r0), (self.x[0] + c0 * self.x[1], self.x[1], c1 - c0), self.epsg)


def _tiles(px: DataFrame, values: list[str], tile: int) -> DataFrame:
    """(tile_r, tile_c, data): each tile's samples, NaN where there is no pixel, compressed."""
    kind = "<c8" if len(values) == 2 else "<f4"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["tile_r"].iloc[0]), int(g["tile_c"].iloc[0])
        z = np.full((tile, tile), np.nan, kind)
        v = g[values[0]].to_numpy(float)
        z[g["r"].to_numpy() - i * tile, g["c"].to_numpy() - j * tile] = v + 1j * g[values[1]].to_numpy(float) if len(values) == 2 else v
        return pd.DataFrame({"tile_r": [i], "tile_c": [j], "data": [zlib.compress(z.tobytes())]})

    at = px.select("r", "c", *values, F.expr(f"r div {tile}").alias("tile_r"), F.expr(f"c div {tile}").alias("tile_c"))
    return at.groupBy("tile_r", "tile_c").applyInPandas(run, "tile_r long, tile_c long, data binary")


def write(px: DataFrame, values: list[str], path: str | Path, grid: Grid, origin: tuple[int, int] = (0, 0), tile: int = TILE) -> Path:
    """Write one real column, or (real, imaginary), of pixels (r, c, ...) as a file of ``grid``.

    ``origin`` is the row and column of ``px`` at the grid's first sample; pixels outside the grid
    are an error of the caller and are left out. The file appears under its name when it is whole.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    rows, columns = grid.shape
    px = px.withColumns({"r": F.col("r") - origin[0], "c": F.col("c") - origin[1]})
    px = px.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1))
    across, down = -(-columns // tile), -(-rows // tile)
    offsets, counts = np.zeros(across * down, "<u8"), np.zeros(across * down, "<u8")
    own = path.with_name(f".{path.name}.{os.getpid()}")
    try:
        with own.open("wb") as out:
            out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
            for t in _tiles(px, values, tile).toLocalIterator():
                k = t.tile_r * across + t.tile_c
                offsets[k], counts[k] = out.tell(), len(t.data)
                out.write(t.data)
            at = _directory(out, grid, len(values) == 2, tile, offsets, counts)
            out.seek(8)
            out.write(struct.pack("<Q", at))
        own.replace(path)
    finally:
        own.unlink(missing_ok=True)
    return path


def _directory(out, grid: Grid, is_complex: bool, tile: int, offsets: np.ndarray, counts: np.ndarray) -> int:
    """Append the file's directory; where it starts."""
    (y, dy, rows), (x, dx, columns) = grid.y, grid.x
    place = [dx, 0, 0, x - dx / 2, 0, dy, 0, y - dy / 2, 0, 0, 0, 0, 0, 0, 0, 1]  # corners, not centres
    geographic = grid.epsg == 4326
    keys = [1, 1, 0, 3, _MODEL, 0, 1, 2 if geographic else 1, _RASTER, 0, 1, 1, _GEOGRAPHIC if geographic else _PROJECTED, 0, 1, grid.epsg]
    fields = [
        (_WIDTH, 4, [columns]), (_LENGTH, 4, [rows]), (_BITS, 3, [64 if is_complex else 32]), (_COMPRESSION, 3, [8]), (_PHOTOMETRIC, 3, [1]), (_SAMPLES, 3, [1]), (_PLANAR, 3, [1]),
        (_TILE_WIDTH, 4, [tile]), (_TILE_LENGTH, 4, [tile]), (_OFFSETS, 16, offsets), (_COUNTS, 16, counts), (_FORMAT, 3, [6 if is_complex else 3]),
        (_TRANSFORM, 12, place), (_KEYS, 3, keys), (_NODATA, 2, [b"n", b"a", b"n", b"\0"]),
    ]
    entries = []
    for tag, kind, values in fields:
        data = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
        if len(data) > 8:
            out.write(b"\0" * (-out.tell() % 8))
            where = struct.pack("<Q", out.tell())
            out.write(data)
            data = where
        entries.append(struct.pack("<HHQ8s", tag, kind, len(values), data))
    out.write(b"\0" * (-out.tell() % 8))
    at = out.tell()
    out.write(struct.pack("<Q", len(entries)) + b"".join(entries) + struct.pack("<Q", 0))
    return at


def read(path: str | Path) -> tuple[np.ndarray, Grid]:
    """The samples and the grid of a file that ``write`` made; the whole raster, for small ones such as height models."""
    data = Path(path).read_bytes()
    mark, version, _, _, at = struct.unpack_from("<2sHHHQ", data)
    if (mark, version) != (b"II", 43):
        raise ValueError(f"{path} is not a raster of this kind")
    (n,) = struct.unpack_from("<Q", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from("<HHQ", data, at + 8 + 20 * k)
        form = f"<{count}{_TYPES[kind]}"
        start = at + 20 + 20 * k
        tags[tag] = struct.unpack_from(form, data, start if struct.calcsize(form) <= 8 else struct.unpack_from("<Q", data, start)[0])
    (columns,), (rows,), (tile,) = tags[_WIDTH], tags[_LENGTH], tags[_TILE_WIDTH]
    z = np.full((rows, columns), np.nan, "<c8" if tags[_FORMAT] == (6,) else "<f4")
    across = -(-columns // tile)
    for k, (start, size) in enumerate(zip(tags[_OFFSETS], tags[_COUNTS])):
        if size:
            i, j = k // across * tile, k % across * tile
            piece = np.frombuffer(zlib.decompress(data[start : start + size]), z.dtype).reshape(tile, tile)
            z[i : i + tile, j : j + tile] = piece[: rows - i, : columns - j]
    dx, _, _, x, _, dy, _, y = tags[_TRANSFORM][:8]
    return z, Grid((y + dy / 2, dy, rows), (x + dx / 2, dx, columns), tags[_KEYS][-1])
