"""Queries over grids, cubes, orbits and coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import with_sql
from ..functions import geodesy as geo
from ..operators import corrections as cor
from ..operators import geometry as ops
from ..operators import selection
from . import stages
from .raster_queries import r6
from .registry import query

S = SparkSession
EPSG = 32611


def _axes(spark: S, d: str) -> cor.Axes:
    """The cube's grid spans the elevation model's extent."""
    rows = spark.read.parquet(f"{d}/part.parquet").agg(F.max("p_partkey")).first()[0] // 50
    return cor.Axes((800.0, 100.0, 3), (4500000.0, -30.0 * max(rows, 1) / 4, 5), (500000.0, 30.0 * 49 / 4, 5))


def _on_dem(spark: S, d: str, **cubes: float) -> DataFrame:
    return cor.on_surface(fx.dem(spark, d), {n: fx.cube(spark, d, factor) for n, factor in cubes.items()}, _axes(spark, d))


_AT = """ix AS (SELECT *, (elev - 800e0)/100e0 AS fk, r*4e0/(SELECT greatest(max(r), 1) FROM dem) AS fj, c*4e0/49e0 AS fi FROM dem),
w0 AS (SELECT *, least(floor(fk), 1)::BIGINT AS k0, least(floor(fj), 3)::BIGINT AS j0, least(floor(fi), 3)::BIGINT AS i0 FROM ix),
w AS (SELECT w0.r, w0.c, elev, x, y, sum(v*(CASE WHEN k = k0 THEN 1 - (fk - k0) ELSE fk - k0 END)*(CASE WHEN j = j0 THEN 1 - (fj - j0) ELSE fj - j0 END)*(CASE WHEN i = i0 THEN 1 - (fi - i0) ELSE fi - i0 END)) AS v
FROM w0 JOIN cube ON k BETWEEN k0 AND k0 + 1 AND j BETWEEN j0 AND j0 + 1 AND i BETWEEN i0 AND i0 + 1 GROUP BY ALL)"""


def _cte(names: str, more: str, body: str) -> str:
    return with_sql(names, "SELECT 1").removesuffix(" SELECT 1") + ", " + more + " " + body


@query(_cte("dem cube", _AT, "SELECT r, c, round(v, 6) AS v FROM w"))
def interp_cube(spark: S, d: str) -> DataFrame:
    return _on_dem(spark, d, v=1.0).select("r", "c", r6("v"))


_PHASE = "(elev/50e0 + r*1e-1)"


def _phase(spark: S, d: str) -> DataFrame:
    return fx.dem(spark, d).select("r", "c", F.expr(_PHASE).alias("unw"))


def _corrected(x: DataFrame) -> DataFrame:
    return x.select("r", "c", (F.round("unw", 6) + 0.0).alias("corrected"))


@query(_cte("dem cube", _AT, f"SELECT r, c, round({_PHASE} - (v + v*5e-1), 6) AS corrected FROM w"))
def correct_troposphere(spark: S, d: str) -> DataFrame:
    return _corrected(cor.correct_troposphere(_phase(spark, d), fx.dem(spark, d), fx.cube(spark, d), fx.cube(spark, d, 0.5), _axes(spark, d)))


@query(with_sql("ph", "SELECT r, c, round(unw - iono, 6) + 0e0 AS corrected FROM ph"))
def correct_ionosphere(spark: S, d: str) -> DataFrame:
    """On one grid an equi-join and a subtraction; on another grid, regrid_bilinear comes first."""
    x = fx.phases(spark, d)
    return _corrected(cor.correct_ionosphere(x.select("r", "c", "unw"), x.select("r", "c", "iono")))


@query(with_sql("ph", "SELECT a.r, a.c, round(a.unw - (b.iono + e.iono)/2, 6) + 0e0 AS corrected FROM ph a LEFT JOIN ph b USING (r, c) LEFT JOIN (SELECT r - 1 AS r, c, iono FROM ph) e USING (r, c)"))
def correct_ionosphere_regridded(spark: S, d: str) -> DataFrame:
    """A screen whose rows lie half a pixel off; outside it is NaN, shown as null."""
    x = fx.phases(spark, d)
    out = cor.correct_ionosphere(x.select("r", "c", "unw"), x.select("r", "c", "iono"), place=(F.col("r") + 0.5, F.col("c") * 1.0))
    return out.select("r", "c", (F.round(F.when(~F.isnan("unw"), F.col("unw")), 6) + 0.0).alias("corrected"))


@query(_cte("dem cube", _AT, f"SELECT r, c, round({_PHASE} - v*15e-1 - (c*1e-2), 6) + 0e0 AS corrected FROM w"))
def correct_atmosphere(spark: S, d: str) -> DataFrame:
    screen = fx.dem(spark, d).select("r", "c", (F.col("c") * 1e-2).alias("iono"))
    return _corrected(cor.correct_atmosphere(_phase(spark, d), fx.dem(spark, d), fx.cube(spark, d), fx.cube(spark, d, 0.5), _axes(spark, d), screen))


_GRAD = """g AS (SELECT *, CASE WHEN lag(elev) OVER a IS NULL THEN (lead(elev) OVER a - elev)/-30e0 WHEN lead(elev) OVER a IS NULL THEN (elev - lag(elev) OVER a)/-30e0 ELSE (lead(elev) OVER a - lag(elev) OVER a)/-60e0 END AS gy,
CASE WHEN lag(elev) OVER b IS NULL THEN (lead(elev) OVER b - elev)/30e0 WHEN lead(elev) OVER b IS NULL THEN (elev - lag(elev) OVER b)/30e0 ELSE (lead(elev) OVER b - lag(elev) OVER b)/60e0 END AS gx
FROM dem WINDOW a AS (PARTITION BY c ORDER BY r), b AS (PARTITION BY r ORDER BY c)),
nn AS (SELECT *, -gx/sqrt(gx*gx + gy*gy + 1) AS nx, -gy/sqrt(gx*gx + gy*gy + 1) AS ny, 1/sqrt(gx*gx + gy*gy + 1) AS nz FROM g)"""


@query(_cte("dem", _GRAD, "SELECT r, c, round(nx, 6) + 0e0 AS nx, round(ny, 6) + 0e0 AS ny, round(nz, 6) AS nz FROM nn"))
def surface_normal(spark: S, d: str) -> DataFrame:
    return ops.surface_normal(fx.dem(spark, d), -30.0, 30.0).select("r", "c", r6("nx"), r6("ny"), r6("nz"))


_LOS = {"lx": 0.1, "ly": 0.05}


@query(_cte("dem cube", _AT, "SELECT r, c, round(v*1e-1, 4) AS lx, round(v*5e-2 + 1e-7, 4) AS ly FROM w"))
def los_on_dem(spark: S, d: str) -> DataFrame:
    x = _on_dem(spark, d, **_LOS).withColumn("ly", F.col("ly") + 1e-7)  # off the rounding ties
    return x.select("r", "c", r6("lx", 4), r6("ly", 4))


@query(
    _cte(
        "dem cube",
        _AT + ", " + _GRAD,
        "SELECT r, c, round(degrees(acos(least(1e0, greatest(-1e0, nx*v*1e-1 + ny*v*5e-2 + nz*sqrt(greatest(0e0, 1 - v*v*125e-4)))))), 4) AS lia FROM w JOIN nn USING (r, c)",
    )
)
def local_incidence_angle(spark: S, d: str) -> DataFrame:
    x = cor.local_incidence_angle(fx.dem(spark, d), fx.cube(spark, d, _LOS["lx"]), fx.cube(spark, d, _LOS["ly"]), _axes(spark, d), -30.0, 30.0)
    return x.select("r", "c", F.round("lia", 4).alias("lia"))


@query(_cte("dem", "z AS (SELECT 1)", "SELECT r, c, round(lon, 8) AS lon, round(lat, 8) AS lat, round(ex, 3) AS ex, round(ey, 3) AS ey, round(ez, 3) AS ez FROM " + stages.sql("(SELECT *, elev AS h FROM dem)", geo.utm_to_lonlat(EPSG) + geo.lonlat_to_ecef())))
def grid_to_ecef(spark: S, d: str) -> DataFrame:
    x = stages.apply(fx.dem(spark, d).withColumn("h", F.col("elev")), geo.utm_to_lonlat(EPSG) + geo.lonlat_to_ecef())
    return x.select("r", "c", r6("lon", 8), r6("lat", 8), r6("ex", 3), r6("ey", 3), r6("ez", 3))


_BOX = "(SELECT min(xmin) AS x0, min(ymin) AS y0, max(xmax) AS x1, max(ymax) AS y1 FROM b0)"
_CORNERS = "c0 AS (SELECT id, unnest([xmin, xmax, xmin, xmax]) AS lon, unnest([ymin, ymin, ymax, ymax]) AS lat FROM (SELECT id, -118 + (id % 7)/1e1 AS xmin, -117 + (id % 7)/1e1 AS xmax, 34 + (id % 5)/1e1 AS ymin, 35 + (id % 5)/1e1 AS ymax FROM (SELECT o_orderkey::BIGINT AS id FROM orders)))"


@query("WITH " + _CORNERS + " SELECT id, round(min(east), 3) AS xmin, round(min(north), 3) AS ymin, round(max(east), 3) AS xmax, round(max(north), 3) AS ymax FROM " + stages.sql("c0", geo.lonlat_to_utm(EPSG)) + " GROUP BY 1")
def reproject_bbox(spark: S, d: str) -> DataFrame:
    """Four corners to UTM, and their envelope."""
    i = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"))
    x0, y0 = "-118 + (id % 7)/1e1", "34 + (id % 5)/1e1"
    corners = F.explode(F.expr(f"array(struct({x0} as lon, {y0} as lat), struct({x0} + 1 as lon, {y0} as lat), struct({x0} as lon, {y0} + 1 as lat), struct({x0} + 1 as lon, {y0} + 1 as lat))"))
    x = stages.apply(i.select("id", corners.alias("p")).select("id", "p.lon", "p.lat"), geo.lonlat_to_utm(EPSG))
    return x.groupBy("id").agg(F.round(F.min("east"), 3).alias("xmin"), F.round(F.min("north"), 3).alias("ymin"), F.round(F.max("east"), 3).alias("xmax"), F.round(F.max("north"), 3).alias("ymax"))


@query(with_sql("dem", "SELECT round(min(lon) - 5e-2, 6) AS west, round(min(lat) - 5e-2, 6) AS south, round(max(lon) + 5e-2, 6) AS east, round(max(lat) + 5e-2, 6) AS north FROM " + stages.sql("(SELECT min(x) AS x, min(y) AS y FROM dem UNION ALL SELECT max(x), max(y) FROM dem)", geo.utm_to_lonlat(EPSG))))
def dem_bounds(spark: S, d: str) -> DataFrame:
    """Two corners of the grid to longitude and latitude, padded."""
    x = fx.dem(spark, d).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    x = x.select(F.explode(F.expr("array(struct(x0 as x, y0 as y), struct(x1 as x, y1 as y))")).alias("p")).select("p.x", "p.y")
    x = stages.apply(x, geo.utm_to_lonlat(EPSG))
    return x.agg(*[F.round(f(v) + s * 0.05, 6).alias(n) for n, f, v, s in (("west", F.min, "lon", -1), ("south", F.min, "lat", -1), ("east", F.max, "lon", 1), ("north", F.max, "lat", 1))])


@query(with_sql("dem", "SELECT r, c, x + 15e0 AS x, y - 15e0 AS y FROM dem"))
def dem_coords(spark: S, d: str) -> DataFrame:
    """Pixel centres from an affine corner grid."""
    return fx.dem(spark, d).select("r", "c", (F.col("x") + 15.0).alias("x"), (F.col("y") - 15.0).alias("y"))


@query(with_sql("dem", "SELECT count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM dem"))
def grid_geometry(spark: S, d: str) -> DataFrame:
    return fx.dem(spark, d).agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


@query(with_sql("dem", "SELECT coalesce(abs(max(CASE WHEN c = 1 THEN x END) - max(CASE WHEN c = 0 THEN x END)), 0) AS dx, coalesce(abs(max(CASE WHEN r = 1 THEN y END) - max(CASE WHEN r = 0 THEN y END)), 0) AS dy FROM dem"))
def coord_resolution(spark: S, d: str) -> DataFrame:
    def step(axis: str, v: str) -> Column:
        return F.coalesce(F.abs(F.max(F.when(F.col(axis) == 1, F.col(v))) - F.max(F.when(F.col(axis) == 0, F.col(v)))), F.lit(0.0))

    return fx.dem(spark, d).where("r < 2 or c < 2").agg(step("c", "x").alias("dx"), step("r", "y").alias("dy"))


@query(with_sql("dem", "SELECT r, c, elev FROM dem WHERE x BETWEEN 500150 AND 500900 AND y BETWEEN 4499900 AND 4500000"))
def crop_bbox(spark: S, d: str) -> DataFrame:
    """A label slice, inclusive, rewritten to index ranges at plan time."""
    rows = spark.read.parquet(f"{d}/part.parquet").agg(F.max("p_partkey")).first()[0] // 50 + 1
    return selection.crop_bbox(fx.dem(spark, d), (4500000.0, -30.0, rows), (500000.0, 30.0, 50), (500150.0, 4499900.0, 500900.0, 4500000.0)).select("r", "c", "elev")


@query(with_sql("dem", "SELECT r, c, elev FROM dem WHERE c BETWEEN 5 AND 30 AND r BETWEEN (SELECT arg_min(r, abs(y - 4499985) + r*1e-9) FROM dem WHERE c = 0) AND (SELECT arg_min(r, abs(y - 4499931) + r*1e-9) FROM dem WHERE c = 0)"))
def crop_nearest(spark: S, d: str) -> DataFrame:
    """The slice between the nearest indices to two coordinates; ties go to the lower index."""
    dem = fx.dem(spark, d)
    near = lambda v: F.min_by("r", F.struct(F.abs(F.col("y") - v), F.col("r")))
    ends = dem.where("c = 0").agg(near(4499985.0).alias("a"), near(4499931.0).alias("b"))
    return dem.crossJoin(F.broadcast(ends)).where("c between 5 and 30 and r between a and b").select("r", "c", "elev")


@query(with_sql("dem", "SELECT a.r, a.c, a.elev AS e1, b.elev AS e2 FROM dem a JOIN (SELECT r, c - 10 AS c, elev FROM dem WHERE c >= 10) b ON a.r = b.r AND a.c = b.c + 0 AND a.c <= 39 AND a.c >= 0"))
def crop_overlap(spark: S, d: str) -> DataFrame:
    """Two rasters cropped to their common extent; both bounds are one-row aggregates."""
    a = fx.dem(spark, d)
    b = a.where("c >= 10").select("r", (F.col("c") - 10).alias("c"), (F.col("x") - 300).alias("x"), "y", F.col("elev").alias("e2"))
    a, b = selection.crop_to_overlap(a, b)
    return a.select("r", "c", F.col("elev").alias("e1")).join(b.select("r", "c", "e2"), ["r", "c"])


@query(with_sql("gr", "SELECT a.id, round(CASE WHEN least((a.xmax-a.xmin)*(a.ymax-a.ymin), 3) > 0 THEN least(1e0, greatest(0e0, least(a.xmax, 11) - greatest(a.xmin, 9)) * greatest(0e0, least(a.ymax, 115e-1) - greatest(a.ymin, 10)) / least((a.xmax-a.xmin)*(a.ymax-a.ymin), 3e0)) ELSE 0e0 END, 6) AS fraction FROM gr a"))
def overlap_fraction(spark: S, d: str) -> DataFrame:
    """Each granule's overlap with one box over the smaller of both areas."""
    g = fx.granules(spark, d)
    both = F.greatest(F.lit(0.0), F.least("xmax", F.lit(11.0)) - F.greatest("xmin", F.lit(9.0))) * F.greatest(F.lit(0.0), F.least("ymax", F.lit(11.5)) - F.greatest("ymin", F.lit(10.0)))
    small = F.least((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")), F.lit(3.0))
    return g.select("id", F.round(F.when(small > 0, F.least(F.lit(1.0), both / small)).otherwise(0.0), 6).alias("fraction"))


@query(with_sql("a b", "SELECT count(*) AS n_common, (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AND count(*) = (SELECT count(*) FROM a) AS same FROM a JOIN b USING (r, c)"))
def grid_match(spark: S, d: str) -> DataFrame:
    """Whether two rasters have the same pixels."""
    a, b = (fx.slc(spark, d, k).select("r", "c", F.lit(k).alias("k")) for k in (0, 1))
    x = a.union(b).groupBy("r", "c").agg(F.count("*").alias("n"))
    return x.agg(F.count_if(F.col("n") == 2).alias("n_common"), (F.count_if(F.col("n") != 2) == 0).alias("same"))


@query(with_sql("ph", "SELECT r, c, round(CASE WHEN r + 1 <= (SELECT max(r) FROM ph) AND c + 1 <= 31 THEN (a.v + b.v + cc.v + dd.v)/4 END, 6) + 0e0 AS v FROM (SELECT r, c, unw AS v FROM ph) a LEFT JOIN (SELECT r - 1 AS r, c, unw AS v FROM ph) b USING (r, c) LEFT JOIN (SELECT r, c - 1 AS c, unw AS v FROM ph) cc USING (r, c) LEFT JOIN (SELECT r - 1 AS r, c - 1 AS c, unw AS v FROM ph) dd USING (r, c)"))
def regrid_bilinear(spark: S, d: str) -> DataFrame:
    """Onto a grid half a pixel off; outside is NaN, shown as null."""
    ph = fx.phases(spark, d)
    ny = ph.agg(F.max("r")).first()[0] + 1
    out = ops.regrid_bilinear(ph, ph.select("r", "c"), "unw", F.col("r") + 0.5, F.col("c") + 0.5, ny, 32)
    return out.select("r", "c", (F.round(F.when(~F.isnan("unw"), F.col("unw")), 6) + 0.0).alias("v"))


_K = 4 * np.pi * 1.257e9 / 299792458.0


@query(_cte("dem cube", _AT, f"SELECT r, c, round(-{stages.num(_K)}*(v*1e-1*2e-2 + v*5e-2*1e-2 + 3e-2), 6) AS phase FROM w"))
def los_phase(spark: S, d: str) -> DataFrame:
    """A displacement projected on the line of sight, as phase."""
    x = _on_dem(spark, d, **_LOS)
    return x.select("r", "c", F.round(cor.displacement_phase(x, 1.257e9, F.lit(0.02), F.lit(0.01), F.lit(0.03)), 6).alias("phase"))


#: Positions as cubics in time, which curve, and which a cubic spline must give back.
_ORBIT = {"x": (-2400000.0, 700.0, -1.2, 4e-3), "y": (-5400000.0, 1500.0, 2.1, -3e-3), "z": (4200000.0, 7200.0, -2.4, 1e-3)}
_AHEAD = {"x": 60.0, "y": -45.0, "z": 20.0}
_T = np.arange(20) * 10.0


def _place(axis: str, t: str, more: float = 0.0, slope: float = 0.0) -> str:
    a, b, c, e = _ORBIT[axis]
    return f"({stages.num(a + more)} + {t}*({stages.num(b + slope)} + {t}*({stages.num(c)} + {t}*{stages.num(e)})))"


def _speed(axis: str, t: str) -> str:
    _, b, c, e = _ORBIT[axis]
    return f"({stages.num(b)} + {t}*({stages.num(2 * c)} + {t}*{stages.num(3 * e)}))"


def _states(spark: S, more: float = 0.0, slope: float = 0.0) -> DataFrame:
    """(t, px..pz, vx..vz): 20 state vectors; a second orbit runs beside the first and slowly away from it."""
    t = spark.createDataFrame([(float(x),) for x in _T], "t double")
    return t.select("t", *[F.expr(_place(v, "t", more * _AHEAD[v], slope)).alias(f"p{v}") for v in "xyz"], *[F.expr(_speed(v, "t")).alias(f"v{v}") for v in "xyz"])


@query("SELECT n, round(t, 6) AS t, " + ", ".join(f"round({_place(v, 't')}, 3) AS p0{v}" for v in "xyz") + " FROM (SELECT o_orderkey::BIGINT AS n, (o_orderkey::BIGINT % 1900)/1e1 AS t FROM orders)")
def orbit_interp(spark: S, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("n")).withColumn("t", F.expr("(n % 1900)/1e1"))
    states = cor.orbit_of(_states(spark))
    x = ops.orbit_at(x, "t", states["t"], {f"p0{v}": states[f"p{v}"] for v in "xyz"})
    return x.select("n", r6("t"), *[r6(f"p0{v}", 3) for v in "xyz"])


_GRID = [{"x": "500000e0 + 100e0*i", "y": "4000000e0 + 100e0*j", "ref_time": "50 + 5e0*j + i", "sec_time": "515e-1 + 5e0*j + i"}]


def _baseline_sql(height: str) -> str:
    places = [{f"r{v}": _place(v, "ref_time") for v in "xyz"} | {f"v{v}": _speed(v, "ref_time") for v in "xyz"} | {f"s{v}": _place(v, "sec_time", _AHEAD[v], 0.3) for v in "xyz"}]
    points = f"(SELECT n_nationkey::BIGINT // 5 AS j, n_nationkey::BIGINT % 5 AS i, {height} AS h FROM nation)"
    return "SELECT j, i, round(b_perp, 4) AS b_perp, round(b_par, 4) AS b_par FROM " + stages.sql(points, _GRID + geo.utm_to_lonlat(EPSG) + geo.lonlat_to_ecef() + places + geo.baseline())


def _grid(spark: S, d: str) -> DataFrame:
    """A radar grid of three layers at 0, 250 and 500 metres."""
    n = F.col("n_nationkey").cast("long")
    x = spark.read.parquet(f"{d}/nation.parquet").select(F.expr("cast(n_nationkey as bigint) div 5").alias("j"), (n % 5).alias("i"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    return stages.apply(x.withColumn("h", F.col("k") * 250.0), _GRID)


@query(_baseline_sql("250e0"))
def baseline(spark: S, d: str) -> DataFrame:
    """Perpendicular and parallel baseline of a radar grid's middle layer, each orbit at its own azimuth times."""
    return cor.compute_baseline(_grid(spark, d), _states(spark), _states(spark, 1.0, 0.3), EPSG).select("j", "i", r6("b_perp", 4), r6("b_par", 4))


@query(_baseline_sql("1000 + 10e0*n_nationkey"))
def baseline_on_dem(spark: S, d: str) -> DataFrame:
    """The same with ground heights of its own."""
    dem = _grid(spark, d).where("k = 0").select("j", "i", (1000 + 10.0 * (F.col("j") * 5 + F.col("i"))).alias("h"))
    return cor.compute_baseline(_grid(spark, d), _states(spark), _states(spark, 1.0, 0.3), EPSG, dem).select("j", "i", r6("b_perp", 4), r6("b_par", 4))


@query(with_sql("cube", "SELECT round(median(v), 6) AS median, round(coalesce(max(CASE WHEN j = 2 AND i = 2 THEN v END), median(v)), 6) AS centre FROM cube WHERE k = 1"))
def scene_center_baseline(spark: S, d: str) -> DataFrame:
    """Median and centre of the middle layer."""
    x = fx.cube(spark, d).where("k = 1 and not isnan(v)")
    return x.agg(F.round(F.median("v"), 6).alias("median"), F.round(F.coalesce(F.max(F.when(F.expr("j = 2 and i = 2"), F.col("v"))), F.median("v")), 6).alias("centre"))
