"""Interferograms, multilooking and coherence over pixel tables keyed by integer (r, c)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def phase(re: Column, im: Column) -> Column:
    """The angle in radians; 0 for a zero sample."""
    return F.atan2(im, re)


def safe_div(n: Column, d: Column, other: float = 0.0) -> Column:
    """n / d, or ``other`` where d is not positive or not a number (ANSI mode raises on a bare zero)."""
    return F.when((d > 0) & ~F.isnan(d), n / d).otherwise(F.lit(other))


def interferogram(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """keys, re1, im1, re2, im2 and re, im of a * conj(b); an equi-join on the grid index."""
    x = a.select(*keys, F.col("re").alias("re1"), F.col("im").alias("im1"))
    y = b.select(*keys, F.col("re").alias("re2"), F.col("im").alias("im2"))
    return x.join(y, list(keys)).withColumn("re", F.expr("re1 * re2 + im1 * im2")).withColumn("im", F.expr("im1 * re2 - re1 * im2"))


def shape(px: DataFrame) -> tuple[int, int]:
    """(rows, columns) of a pixel table, from its largest indices; one aggregate to the driver."""
    top = px.agg(F.max("r"), F.max("c")).first()
    return (0, 0) if top[0] is None else (top[0] + 1, top[1] + 1)


def multilook(px: DataFrame, values: list[str], ly: int, lx: int, ny: int, nx: int) -> DataFrame:
    """(lr, lc) and the mean of each value over blocks of ly by lx; rest rows and columns are cut.

    Partial sums are formed before the shuffle. NaN in a block makes its mean NaN.
    """
    if ly < 1 or lx < 1:
        raise ValueError("looks must be at least 1")
    kept = px.where((F.col("r") < ny // ly * ly) & (F.col("c") < nx // lx * lx))
    return kept.groupBy(F.expr(f"r div {ly}").alias("lr"), F.expr(f"c div {lx}").alias("lc")).agg(*[F.avg(v).alias(v) for v in values])


def multilook_coherence(a: DataFrame, b: DataFrame, ly: int, lx: int, ny: int, nx: int) -> DataFrame:
    """(lr, lc, re, im, coh): numerator and powers in one aggregate; 0 where the power is not positive, not clipped."""
    x = interferogram(a, b).withColumn("p1", F.expr("re1 * re1 + im1 * im1")).withColumn("p2", F.expr("re2 * re2 + im2 * im2"))
    m = multilook(x, ["re", "im", "p1", "p2"], ly, lx, ny, nx)
    top, under = F.sqrt(F.expr("re * re + im * im")), F.sqrt(F.expr("p1 * p2"))
    return m.select("lr", "lc", "re", "im", safe_div(top, under).alias("coh"))


def _reflected(px: DataFrame, axis: str, n: int, h: int) -> DataFrame:
    """Rows with ``pos``: each sample at every position of [-h, n + h) that symmetric reflection maps to it."""
    k = math.ceil((h + n) / (2 * n))
    at = [F.col(axis) + 2 * n * j for j in range(-k, k + 1)] + [-1 - F.col(axis) + 2 * n * j for j in range(-k, k + 1)]
    places = F.array_distinct(F.filter(F.array(*at), lambda p: (p >= -h) & (p < n + h)))
    return px.withColumn("pos", F.explode(places))


def smooth(px: DataFrame, values: list[str], axis: str, n: int, weights: list[float]) -> DataFrame:
    """Weighted sums along one axis with symmetric reflection; ``weights`` are centred, of odd length."""
    h, other = len(weights) // 2, "c" if axis == "r" else "r"
    w = Window.partitionBy(other).orderBy("pos")
    even = len(set(weights)) == 1
    padded = _reflected(px, axis, n, h)

    def one(v: str) -> Column:
        if even:
            return F.avg(v).over(w.rowsBetween(-h, h))
        total = F.lit(0.0)
        for k, weight in enumerate(weights):
            total = total + F.lag(v, h - k).over(w) * weight
        return total

    return padded.select(other, "pos", *[one(v).alias(v) for v in values]).where(f"pos >= 0 and pos < {n}").withColumnRenamed("pos", axis)


def boxcar(size: int) -> list[float]:
    if size < 1 or size % 2 == 0:
        raise ValueError("the window must be odd and at least 1")
    return [1.0 / size] * size


def gaussian(sigma: float) -> list[float]:
    if sigma < 1:
        raise ValueError("sigma must be at least 1")
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def coherence(a: DataFrame, b: DataFrame, weights: list[float], ny: int, nx: int) -> DataFrame:
    """(r, c, coh) by separable windows: |<s1 s2*>| / sqrt(<|s1|^2><|s2|^2>), clipped to [0, 1]."""
    values = ["re", "im", "p1", "p2"]
    x = interferogram(a, b).select("r", "c", "re", "im", F.expr("re1 * re1 + im1 * im1").alias("p1"), F.expr("re2 * re2 + im2 * im2").alias("p2"))
    x = smooth(smooth(x, values, "r", ny, weights), values, "c", nx, weights)
    coh = safe_div(F.sqrt(F.expr("re * re + im * im")), F.sqrt(F.expr("p1 * p2")))
    return x.select("r", "c", F.least(F.greatest(coh, F.lit(0.0)), F.lit(1.0)).alias("coh"))


def apply_mask(px: DataFrame, value: str, mask: str, valid: int = 0, fill: float = math.nan) -> DataFrame:
    """``value`` where the mask equals ``valid``, else ``fill``."""
    return px.withColumn(value, F.when(F.col(mask) == valid, F.col(value)).otherwise(F.lit(fill)))


def slc_valid(mask: Column) -> Column:
    return (mask != 0) & (mask != 255)


def gunw_valid(mask: Column) -> Column:
    """Both subswath digits are set; water (hundreds) is kept."""
    return (F.floor(mask / 10) % 10 != 0) & (mask % 10 != 0) & (mask != 255)


def to_db(x: Column, power: bool = True) -> Column:
    """10 (power) or 20 (amplitude) times log10 |x|; zero is minus infinity."""
    return F.when(x == 0, F.lit(-math.inf)).otherwise(F.log10(F.abs(x)) * (10 if power else 20))


def from_db(x: Column, power: bool = True) -> Column:
    return F.pow(F.lit(10.0), x / (10.0 if power else 20.0))


def gradient(px: DataFrame, value: str, axis: str, spacing: float, out: str) -> DataFrame:
    """Central differences inside, one-sided at the edges, by a signed uniform spacing."""
    w = Window.partitionBy("c" if axis == "r" else "r").orderBy(axis)
    before, after, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    g = F.when(before.isNull(), (after - x) / spacing).when(after.isNull(), (x - before) / spacing).otherwise((after - before) / (2 * spacing))
    return px.withColumn(out, g)
