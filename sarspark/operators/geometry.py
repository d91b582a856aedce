"""Cube and grid interpolation, orbit splines, surface normals, local incidence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Written
from .sar import gradient


def spline_coefficients(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n-1, 4) power coefficients, low first, of the not-a-knot cubic through (t, y); needs 4 points."""
    n = len(t)
    if n < 4:
        raise ValueError("a cubic spline needs at least 4 points")
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1], b[i] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i], 6 * (d[i] - d[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    return np.stack([y[:-1], d - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)], axis=1)


def orbit_at(points: DataFrame, time_col: str, t: np.ndarray, columns: dict[str, np.ndarray]) -> DataFrame:
    """``points`` with each of ``columns`` interpolated at ``time_col``; beyond the ends the end pieces go on.

    An orbit has some dozens of state vectors; its coefficients are literals in the plan, and the
    piece is found by a search expression, so nothing shuffles.
    """
    knots = F.array(*[F.lit(float(x)) for x in t])
    piece = F.greatest(F.lit(0), F.least(F.lit(len(t) - 2), F.size(F.filter(knots, lambda k: k <= F.col(time_col))) - 1))
    out = points.withColumn("_k", piece).withColumn("_u", F.col(time_col) - F.get(knots, F.col("_k")))
    for name, y in columns.items():
        c = [F.get(F.array(*[F.lit(float(x)) for x in col]), F.col("_k")) for col in spline_coefficients(t, y).T]
        u = F.col("_u")
        out = out.withColumn(name, c[0] + u * (c[1] + u * (c[2] + u * c[3])))
    return out.drop("_k", "_u")


#: Cells a side of a cube's block.
BLOCK = 64


def cube_blocks(cube: DataFrame, dims: tuple[int, int, int], block: int = BLOCK) -> DataFrame:
    """(_jb, _ib, _cube): a (k, j, i, v) cube as blocks of cells, each with the samples of its far edges, as arrays in (k, j, i) order."""

    def spread(c: str, n: int) -> Column:
        last = max((n - 2) // block, 0)
        return F.explode(F.sequence(F.expr(f"greatest({c} - 1, 0L) div {block}"), F.least(F.expr(f"{c} div {block}"), F.lit(last).cast("long"))))

    copied = cube.select("k", F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), "v")
    copied = copied.withColumn("_jb", spread("j", dims[1])).withColumn("_ib", spread("i", dims[2]))
    values = F.transform(F.array_sort(F.collect_list(F.struct("k", "j", "i", "v"))), lambda s: s["v"])
    return copied.groupBy("_jb", "_ib").agg(values.alias("_cube"))


def interpolate_cube(px: DataFrame, cube: DataFrame, out: str, fk: Column, fj: Column, fi: Column, dims: tuple[int, int, int], block: int = BLOCK) -> DataFrame:
    """``px`` with ``out``, the trilinear value at fractional indices; NaN outside the cube.

    Pixels meet the block that holds their cell and read its eight corners from one array. Blocks
    are written, so Spark knows their size: coarse cubes are broadcast and the pixel table does not
    move; a fine one is joined by block.
    """
    nk, nj, ni = dims
    inside = F.lit(True)
    base, rest = [], []
    for f, n in zip((fk, fj, fi), dims):
        inside = inside & (f >= 0) & (f <= n - 1)
        cell = F.least(F.greatest(F.floor(f), F.lit(0)), F.lit(max(n - 2, 0)))
        base.append(cell.cast("long"))
        rest.append(f - cell)
    blocks = Written(cube_blocks(cube, dims, block)).df
    jb, ib = (F.floor(b / F.lit(block)).cast("long") for b in base[1:])
    met = px.withColumn("_jb", F.when(inside, jb)).withColumn("_ib", F.when(inside, ib)).join(blocks, ["_jb", "_ib"], "left")
    high, wide = (F.least(F.lit(block + 1).cast("long"), n - F.col(v) * block) for n, v in ((nj, "_jb"), (ni, "_ib")))
    total = F.lit(0.0)
    for dk in (0, 1):
        for dj in (0, 1):
            for di in (0, 1):
                weight = F.lit(1.0)
                for d, r in zip((dk, dj, di), rest):
                    weight = weight * (r if d else 1 - r)
                at = ((base[0] + dk) * high + base[1] + dj - F.col("_jb") * block) * wide + base[2] + di - F.col("_ib") * block
                total = total + weight * F.get("_cube", at.cast("int"))
    return met.withColumn(out, F.when(F.col("_jb").isNotNull(), total).otherwise(F.lit(float("nan")))).drop("_cube", "_jb", "_ib")


def regrid_bilinear(source: DataFrame, target: DataFrame, value: str, fr: Column, fc: Column, ny: int, nx: int) -> DataFrame:
    """``target`` with ``value`` of ``source`` at fractional (row, column); NaN outside. Four corners, one equi-join."""
    inside = (fr >= 0) & (fr <= ny - 1) & (fc >= 0) & (fc <= nx - 1)
    keys = target.columns
    r0, c0 = F.least(F.floor(fr), F.lit(ny - 2)), F.least(F.floor(fc), F.lit(nx - 2))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    at = target.withColumn("_r0", F.when(inside, r0)).withColumn("_c0", F.when(inside, c0)).withColumn("_fr", fr).withColumn("_fc", fc).withColumn("_k", corner)
    at = at.withColumn("_r", F.col("_r0") + F.col("_k.a")).withColumn("_c", F.col("_c0") + F.col("_k.b"))
    wr, wc = F.col("_fr") - F.col("_r0"), F.col("_fc") - F.col("_c0")
    weight = F.when(F.col("_k.a") == 1, wr).otherwise(1 - wr) * F.when(F.col("_k.b") == 1, wc).otherwise(1 - wc)
    values = source.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value).alias("_v"))
    met = at.join(values, (F.col("_r") == F.col("_sr")) & (F.col("_c") == F.col("_sc")), "left")
    return met.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_v") * weight), F.lit(float("nan"))).alias(value))


def surface_normal(dem: DataFrame, dy: float, dx: float) -> DataFrame:
    """``dem`` with the unit normal nx, ny, nz of its surface."""
    g = gradient(gradient(dem, "elev", "r", dy, "gy"), "elev", "c", dx, "gx")
    norm = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    return g.select(*dem.columns, (-F.col("gx") / norm).alias("nx"), (-F.col("gy") / norm).alias("ny"), (1 / norm).alias("nz"))


def incidence(nx: Column, ny: Column, nz: Column, lx: Column, ly: Column, lz: Column) -> Column:
    """The angle between normal and line of sight in degrees."""
    dot = nx * lx + ny * ly + nz * lz
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))


def axes_match(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> bool:
    """Whether two axes (idx, coord) have the same indices and coordinates within a relative tolerance; one aggregate."""
    y = b.select("idx", F.col("coord").alias("other"))
    off = F.col("coord").isNull() | F.col("other").isNull() | (F.abs(F.col("coord") - F.col("other")) > F.abs(F.col("other")) * tolerance)
    return a.join(y, "idx", "full").agg(F.count_if(off).alias("n")).first()["n"] == 0
