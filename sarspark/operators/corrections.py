"""Corrections, lines of sight, incidence and baselines as operators over pixel, cube and orbit tables.

Pixels are (r, c, value), elevation models (r, c, x, y, elev), cubes (k, j, i, v) on regular axes
of height, y and x. An axis is (first coordinate, signed step, count).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy as geo
from ..plans import stages
from . import geometry, sar

LIGHT = 299792458.0


@dataclass(frozen=True)
class Axes:
    """The axes of a cube; steps may be negative."""

    height: tuple[float, float, int]
    y: tuple[float, float, int]
    x: tuple[float, float, int]

    def at(self, height: Column, y: Column, x: Column) -> tuple[Column, ...]:
        return tuple((v - first) / step for v, (first, step, _) in zip((height, y, x), (self.height, self.y, self.x)))

    @property
    def counts(self) -> tuple[int, int, int]:
        return self.height[2], self.y[2], self.x[2]


def on_surface(dem: DataFrame, cubes: dict[str, DataFrame], axes: Axes) -> DataFrame:
    """``dem`` with each cube's value at its pixels' places and heights; NaN outside the cube."""
    for name, cube in cubes.items():
        dem = geometry.interpolate_cube(dem, cube, name, *axes.at(F.col("elev"), F.col("y"), F.col("x")), axes.counts)
    return dem


def correct_troposphere(phase: DataFrame, dem: DataFrame, hydrostatic: DataFrame, wet: DataFrame, axes: Axes, value: str = "unw") -> DataFrame:
    """``phase`` less both delays at the surface; the elevation model must have the phase's shape.

    Interpolation is linear, so the delays are added in the coarse cubes and looked up once.
    """
    if sar.shape(phase) != sar.shape(dem):
        raise ValueError(f"the elevation model is {sar.shape(dem)}, the phase {sar.shape(phase)}")
    both = hydrostatic.join(wet.select("k", "j", "i", F.col("v").alias("w")), ["k", "j", "i"]).select("k", "j", "i", (F.col("v") + F.col("w")).alias("v"))
    delay = on_surface(dem.select("r", "c", "x", "y", "elev"), {"_delay": both}, axes).select("r", "c", "_delay")
    return phase.join(delay, ["r", "c"]).withColumn(value, F.col(value) - F.col("_delay")).drop("_delay")


def correct_ionosphere(phase: DataFrame, screen: DataFrame, value: str = "unw", screen_value: str = "iono", place: tuple[Column, Column] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """``phase`` less an ionosphere screen on its grid, or on another one.

    ``place`` gives the screen's fractional row and column of a phase pixel; then the screen, of
    that ``shape``, is looked up bilinearly and pixels outside it are NaN.
    """
    screen = screen.select("r", "c", F.col(screen_value).alias("_screen"))
    if place is not None:
        ny, nx = shape or sar.shape(screen)
        screen = geometry.regrid_bilinear(screen, phase.select("r", "c"), "_screen", *place, ny, nx)
    return phase.join(screen, ["r", "c"]).withColumn(value, F.col(value) - F.col("_screen")).drop("_screen")


def correct_atmosphere(phase: DataFrame, dem: DataFrame, hydrostatic: DataFrame, wet: DataFrame, axes: Axes, screen: DataFrame | None = None, value: str = "unw", **ionosphere) -> DataFrame:
    """The troposphere's correction, and the ionosphere's where a screen is given."""
    out = correct_troposphere(phase, dem, hydrostatic, wet, axes, value)
    return out if screen is None else correct_ionosphere(out, screen, value, **ionosphere)


def finalized(phase: DataFrame, value: str, applied: str) -> DataFrame:
    """The value in single precision, with a column ``applied`` that names the corrections."""
    return phase.withColumn(value, F.col(value).cast("float")).withColumn("applied", F.lit(applied))


def line_of_sight(dem: DataFrame, x: DataFrame, y: DataFrame, axes: Axes) -> DataFrame:
    """``dem`` with lx, ly from their cubes and lz from the unit length."""
    out = on_surface(dem, {"lx": x, "ly": y}, axes)
    return out.withColumn("lz", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("lx") * F.col("lx") - F.col("ly") * F.col("ly"))))


def local_incidence_angle(dem: DataFrame, x: DataFrame, y: DataFrame, axes: Axes, dy: float, dx: float) -> DataFrame:
    """(r, c, lia): degrees between the surface's normal and the line of sight."""
    n = geometry.surface_normal(line_of_sight(dem, x, y, axes), dy, dx)
    return n.select("r", "c", geometry.incidence(*[F.col(v) for v in ("nx", "ny", "nz", "lx", "ly", "lz")]).alias("lia"))


def displacement_phase(px: DataFrame, frequency: float, east: Column, north: Column, up: Column) -> Column:
    """The phase of a displacement along the line of sight lx, ly and up."""
    return -F.lit(4 * np.pi * frequency / LIGHT) * (F.col("lx") * east + F.col("ly") * north + up)


def orbit_of(orbit: DataFrame) -> dict[str, np.ndarray]:
    """t, px, py, pz, vx, vy, vz of an orbit's state vectors, by time; some dozens of rows."""
    names = ("t", "px", "py", "pz", "vx", "vy", "vz")
    rows = orbit.select(*names).orderBy("t").collect()
    return {n: np.array([r[n] for r in rows], float) for n in names}


def compute_baseline(grid: DataFrame, reference: DataFrame, secondary: DataFrame, epsg: int, dem: DataFrame | None = None) -> DataFrame:
    """(j, i, b_perp, b_par) on a radar grid (k, j, i, x, y, h, ref_time, sec_time) with two orbits' state vectors.

    The middle layer's azimuth times count, each orbit's its own. Ground heights are ``dem``'s
    (j, i, h), or else the layer's; a layer without a height lies at 0.
    """
    layers = grid.agg(F.max("k")).first()[0]
    middle = grid.where(F.col("k") == ((layers or 0) + 1) // 2)
    if dem is not None:
        middle = middle.drop("h").join(dem.select("j", "i", "h"), ["j", "i"])
    points = stages.apply(middle.withColumn("h", F.coalesce("h", F.lit(0.0))), geo.utm_to_lonlat(epsg) + geo.lonlat_to_ecef())
    ref, sec = orbit_of(reference), orbit_of(secondary)
    points = geometry.orbit_at(points, "ref_time", ref["t"], {"rx": ref["px"], "ry": ref["py"], "rz": ref["pz"], "vx": ref["vx"], "vy": ref["vy"], "vz": ref["vz"]})
    points = geometry.orbit_at(points, "sec_time", sec["t"], {"sx": sec["px"], "sy": sec["py"], "sz": sec["pz"]})
    return stages.apply(points, geo.baseline()).select("j", "i", "b_perp", "b_par")
