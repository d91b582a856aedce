"""Choosing channels, masks and windows of products, and their summaries, as operators over tables.

Images are rows (frequency, polarization, r, c, ...), masks (frequency, r, c, mask); layers of
interferograms have a column ``layer`` besides, and each layer its own mask.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import products
from . import sar

#: Names of the layers of an interferogram product.
LAYERS = ("unwrappedInterferogram", "wrappedInterferogram", "pixelOffsets")


def _one(px: DataFrame, column: str, wanted: str, what: str) -> DataFrame:
    """Rows of one channel; an error names those that there are (a handful of names)."""
    found = px.where(F.col(column) == wanted)
    if found.isEmpty():
        names = sorted(str(r[0]) for r in px.select(column).distinct().collect())
        raise ValueError(f"no {what} {wanted}; available: {', '.join(names) or 'none'}")
    return found


def _masked(px: DataFrame, mask: DataFrame, values: list[str], valid: Column) -> DataFrame:
    """``px`` with NaN where the mask says so; pixels that the mask lacks are invalid."""
    met = px.join(mask.select("r", "c", "mask"), ["r", "c"], "left")
    for v in values:
        met = met.withColumn(v, F.when(F.col("mask").isNotNull() & valid, F.col(v)).otherwise(F.lit(math.nan)))
    return met.drop("mask")


def get_mask(masks: DataFrame, frequency: str = "A", layer: str | None = None) -> DataFrame:
    """(r, c, mask) of a frequency, and of a layer where masks have one."""
    found = _one(masks, "frequency", products.frequency(frequency), "mask of")
    return (_one(found, "layer", layer, "mask of layer") if layer else found).select("r", "c", "mask")


def get_slc(images: DataFrame, polarization: str = "HH", frequency: str = "A", masks: DataFrame | None = None, product_type: str | None = None) -> DataFrame:
    """(r, c, re, im) of one channel; with ``masks`` samples outside all subswaths are NaN."""
    if product_type and product_type != "GSLC":
        raise ValueError(f"a GSLC is needed, not {product_type}")
    px = _one(images, "frequency", products.frequency(frequency), "frequency")
    px = _one(px, "polarization", polarization, "polarization").select("r", "c", "re", "im")
    return px if masks is None else _masked(px, get_mask(masks, frequency), ["re", "im"], sar.slc_valid(F.col("mask")))


def get_gunw(bands: DataFrame, value: str, polarization: str = "HH", layer: str = LAYERS[0], frequency: str = "A", masks: DataFrame | None = None, product_type: str | None = None) -> DataFrame:
    """(r, c, value) of one layer's variable; with ``masks`` pixels outside either subswath are NaN, water stays."""
    if product_type and product_type != "GUNW":
        raise ValueError(f"a GUNW is needed, not {product_type}")
    if layer not in LAYERS:
        raise ValueError(f"no layer {layer}; one of {', '.join(LAYERS)}")
    px = _one(bands, "frequency", products.frequency(frequency), "frequency")
    px = _one(_one(px, "layer", layer, "layer"), "polarization", polarization, "polarization")
    if value not in px.columns:
        raise ValueError(f"no variable {value}; available: {', '.join(c for c in px.columns if c not in ('frequency', 'layer', 'polarization', 'r', 'c'))}")
    px = px.select("r", "c", F.col(value).cast("double").alias(value))
    return px if masks is None else _masked(px, get_mask(masks, frequency, layer), [value], sar.gunw_valid(F.col("mask")))


def index_range(axis: tuple[float, float, int], low: float, high: float) -> tuple[int, int]:
    """The indices (first, last) of a regular axis (first coordinate, signed step, count) inside [low, high]; empty is (0, -1)."""
    first, step, n = axis
    a, b = sorted(((low - first) / step, (high - first) / step))
    i, j = max(math.ceil(a - 1e-9), 0), min(math.floor(b + 1e-9), n - 1)
    return (i, j) if i <= j else (0, -1)


def crop_bbox(px: DataFrame, y: tuple[float, float, int], x: tuple[float, float, int], box: tuple[float, float, float, float]) -> DataFrame:
    """Pixels in a box (xmin, ymin, xmax, ymax), ends included, as index ranges that reach the scan; either direction of y."""
    (r0, r1), (c0, c1) = index_range(y, box[1], box[3]), index_range(x, box[0], box[2])
    if r1 < r0 or c1 < c0:
        ends = [sorted((a, a + s * (n - 1))) for a, s, n in (x, y)]
        raise ValueError(f"the box {box} does not meet x {ends[0]}, y {ends[1]}")
    return px.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def crop_to_overlap(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both (r, c, x, y, ...) rasters inside their common extent; an error if they have none."""
    ends = [t.agg(*[f(v) for v in ("x", "y") for f in (F.min, F.max)]).first() for t in (a, b)]
    if any(v is None for e in ends for v in e):
        raise ValueError("a raster is empty")
    (x0, x1), (y0, y1) = ((max(e[k] for e in ends), min(e[k + 1] for e in ends)) for k in (0, 2))
    if x0 >= x1 or y0 >= y1:
        raise ValueError("the rasters do not overlap")
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return a.where(inside), b.where(inside)


def array_stats(px: DataFrame, value: str) -> DataFrame:
    """One row: n, total, fraction, lo, hi, mean, median, q25, q75 of the finite values; quartiles are exact."""
    x = F.col(value)
    v = F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = px.agg(F.count(v).alias("n"), F.count("*").alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), q.alias("q"))
    part = F.when(F.col("total") > 0, F.col("n") / F.col("total").cast("double"))
    return a.select("n", "total", part.alias("fraction"), "lo", "hi", "mean", *[F.get("q", F.lit(k)).alias(n) for k, n in ((1, "median"), (0, "q25"), (2, "q75"))])


def fit_metrics(px: DataFrame, measured: str, model: str, centred: bool = False) -> DataFrame:
    """One row: n, pearson, rmse, r2 of ``model`` against ``measured`` where both are finite.

    With ``centred`` each loses its median first, as for phases of an unknown offset.
    """
    ok = [~F.isnan(v) & (F.abs(F.col(v)) != math.inf) for v in (measured, model)]
    both = px.where(ok[0] & ok[1]).select(F.col(measured).alias("a"), F.col(model).alias("b"))
    if centred:
        middle = both.agg(F.median("a").alias("ma"), F.median("b").alias("mb"))  # one row
        both = both.crossJoin(F.broadcast(middle)).select((F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"))
    off = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))
    m = both.agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.avg(off).alias("mse"), F.var_pop("a").alias("var"))
    return m.select("n", "pearson", F.sqrt("mse").alias("rmse"), (1 - sar.safe_div(F.col("mse"), F.col("var"))).alias("r2"))
