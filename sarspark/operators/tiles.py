"""Tile tables: one row holds a tile's samples as arrays; the storage form for whole scenes.

A pair of scenes is joined by tile and not by pixel, so a join row stands for a whole tile, and
numpy works on its arrays in Arrow batches. Tiles are explicit keys of bounded size; no task
holds more than a batch of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 512
SCHEMA = "ty long, tx long, h int, w int, re array<float>, im array<float>"


def to_tiles(px: DataFrame, ny: int, nx: int, tile: int = TILE) -> DataFrame:
    """A (r, c, re, im) pixel table as tiles; pixels that are not there are NaN."""
    keyed = px.select(F.expr(f"r div {tile}").alias("ty"), F.expr(f"c div {tile}").alias("tx"), "r", "c", "re", "im")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(g["ty"].iloc[0]), int(g["tx"].iloc[0])
        h, w = min(tile, ny - ty * tile), min(tile, nx - tx * tile)
        at = (g["r"].to_numpy() - ty * tile) * w + g["c"].to_numpy() - tx * tile
        parts = []
        for name in ("re", "im"):
            z = np.full(h * w, np.nan, np.float32)
            z[at] = g[name]
            parts.append(z)
        return pd.DataFrame({"ty": [ty], "tx": [tx], "h": [h], "w": [w], "re": [parts[0]], "im": [parts[1]]})

    return keyed.groupBy("ty", "tx").applyInPandas(run, SCHEMA)


def to_pixels(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """The inverse, lazily: tiles are unpacked where they are, after any filter on them."""
    x = tiles.select("ty", "tx", "w", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return x.select((F.col("ty") * tile + F.expr("k div w")).alias("r"), (F.col("tx") * tile + F.expr("k % w")).alias("c"), F.col("z.re").cast("double").alias("re"), F.col("z.im").cast("double").alias("im"))


def _arrays(batch: pa.RecordBatch, row: int, shape: tuple[int, int], names: tuple[str, ...]) -> list[np.ndarray]:
    """The complex tiles of one row."""
    parts = [batch.column(n)[row].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape) for n in names]
    return [parts[k] + 1j * parts[k + 1] for k in range(0, len(parts), 2)]


def multilook_coherence(a: DataFrame, b: DataFrame, ly: int, lx: int, ny: int, nx: int, tile: int = TILE) -> DataFrame:
    """(lr, lc, re, im, coh) of two tile tables, as the pixel form gives; looks must divide the tile."""
    if tile % ly or tile % lx:
        raise ValueError("looks must divide the tile")
    other = b.select("ty", "tx", F.col("re").alias("re2"), F.col("im").alias("im2"))
    pairs = a.join(other, ["ty", "tx"]).select("ty", "tx", "h", "w", "re", "im", "re2", "im2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (ty, tx, h, w) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(4)])):
                m, n = h // ly, w // lx
                if not m or not n:
                    continue
                z1, z2 = _arrays(batch, k, (h, w), ("re", "im", "re2", "im2"))

                def mean(x: np.ndarray) -> np.ndarray:
                    return x[: m * ly, : n * lx].reshape(m, ly, n, lx).mean((1, 3))

                top = mean(z1 * z2.conj())
                under = np.sqrt(mean(np.abs(z1) ** 2) * mean(np.abs(z2) ** 2))
                coh = np.divide(np.abs(top), under, out=np.zeros_like(under), where=under > 0)
                r, c = np.meshgrid(np.arange(m) + ty * tile // ly, np.arange(n) + tx * tile // lx, indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (r, c, top.real, top.imag, coh)], names=["lr", "lc", "re", "im", "coh"])

    return pairs.mapInArrow(run, "lr long, lc long, re double, im double, coh double")
