"""Queries over rasters: projections, masks, interferometry, windows, kernels, polarimetry, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import with_sql
from ..functions import polarimetry as pol
from ..operators import kernels, sar, selection, tiles
from ..session import importable
from . import stages
from .registry import query

S = SparkSession


def r6(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


def pair(spark: S, d: str) -> DataFrame:
    return sar.interferogram(fx.slc(spark, d, 0), fx.slc(spark, d, 1))


def _size(spark: S, d: str, by: int = 2) -> tuple[int, int]:
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    return n // by, fx.COLS


_ANGLE = "CASE WHEN re = 0 AND im = 0 THEN 0e0 ELSE atan2(im, re) END"
_NY = "(SELECT max(r) + 1 FROM p)"
_LOOK = "FROM p WHERE r < {ny} // 4 * 4 AND c < 32 GROUP BY 1, 2".format(ny=_NY)


@query(with_sql("p", "SELECT r, c, round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im FROM p"))
def interferogram(spark: S, d: str) -> DataFrame:
    return pair(spark, d).select("r", "c", r6("re"), r6("im"))


@query(with_sql("p", f"SELECT r, c, round(cos({_ANGLE}), 6) + 0e0 AS cos_ph, round(sin({_ANGLE}), 6) + 0e0 AS sin_ph FROM p"))
def calculate_phase(spark: S, d: str) -> DataFrame:
    ph = sar.phase(F.col("re"), F.col("im"))
    return pair(spark, d).select("r", "c", (F.round(F.cos(ph), 6) + 0.0).alias("cos_ph"), (F.round(F.sin(ph), 6) + 0.0).alias("sin_ph"))


@query(with_sql("a", "SELECT r // 4 AS lr, c // 4 AS lc, round(avg(re), 6) + 0e0 AS re, round(avg(im), 6) + 0e0 AS im FROM a WHERE r < (SELECT max(r) + 1 FROM a) // 4 * 4 GROUP BY 1, 2"))
def multilook(spark: S, d: str) -> DataFrame:
    return sar.multilook(fx.slc(spark, d, 0), ["re", "im"], 4, 4, *_size(spark, d)).select("lr", "lc", r6("re"), r6("im"))


@query(with_sql("p", f"SELECT r // 4 AS lr, c // 4 AS lc, round(avg(re), 6) + 0e0 AS re, round(avg(im), 6) + 0e0 AS im {_LOOK}"))
def multilook_interferogram(spark: S, d: str) -> DataFrame:
    return sar.multilook(pair(spark, d), ["re", "im"], 4, 4, *_size(spark, d)).select("lr", "lc", r6("re"), r6("im"))


_LOOKS = with_sql(
        "p",
        f"""SELECT lr, lc, round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im, round(atan2(im, re), 5) + 0e0 AS ph, round(CASE WHEN w > 0 THEN sqrt(re*re + im*im)/w ELSE 0e0 END, 6) AS coh
        FROM (SELECT r // 4 AS lr, c // 4 AS lc, avg(re) AS re, avg(im) AS im, sqrt(avg(re1*re1 + im1*im1)*avg(re2*re2 + im2*im2)) AS w {_LOOK})""",
    )


@query(_LOOKS)
def multilook_coherence(spark: S, d: str) -> DataFrame:
    m = sar.multilook_coherence(fx.slc(spark, d, 0), fx.slc(spark, d, 1), 4, 4, *_size(spark, d))
    return m.select("lr", "lc", r6("re"), r6("im"), (F.round(sar.phase(F.col("re"), F.col("im")), 5) + 0.0).alias("ph"), r6("coh"))


@query(_LOOKS)
def multilook_coherence_tiled(spark: S, d: str) -> DataFrame:
    """The same from tile tables, the form for whole scenes."""
    importable(spark)
    n = _size(spark, d)
    a, b = (tiles.to_tiles(fx.slc(spark, d, k), *n, 64) for k in (0, 1))
    m = tiles.multilook_coherence(a, b, 4, 4, *n, 64)
    return m.select("lr", "lc", r6("re"), r6("im"), (F.round(sar.phase(F.col("re"), F.col("im")), 5) + 0.0).alias("ph"), r6("coh"))


def _window_sql(h: int, weight: str) -> str:
    def fold(x: str, n: str) -> str:
        return f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2*{n} - 1 - ({x}) ELSE {x} END"

    return with_sql(
        "p",
        f"""SELECT r, c, round(CASE WHEN w > 0 THEN least(1e0, sqrt(re*re + im*im)/w) ELSE 0e0 END, 6) AS coh FROM (
        SELECT o.r, o.c, sum(k*s.re) AS re, sum(k*s.im) AS im, sqrt(sum(k*(s.re1*s.re1 + s.im1*s.im1))*sum(k*(s.re2*s.re2 + s.im2*s.im2))) AS w
        FROM (SELECT p.r, p.c, {fold('p.r + y.y', _NY)} AS rr, {fold('p.c + x.x', '32')} AS rc, {weight} AS k FROM p, range(-{h}, {h + 1}) y(y), range(-{h}, {h + 1}) x(x)) o
        JOIN p s ON s.r = o.rr AND s.c = o.rc GROUP BY 1, 2)""",
    )


@query(_window_sql(2, "0.04::DOUBLE"))
def coherence_boxcar(spark: S, d: str) -> DataFrame:
    return sar.coherence(fx.slc(spark, d, 0), fx.slc(spark, d, 1), sar.boxcar(5), *_size(spark, d)).select("r", "c", r6("coh"))


@query(_window_sql(4, "exp(-(y.y*y.y + x.x*x.x)/2e0)"))
def coherence_gaussian(spark: S, d: str) -> DataFrame:
    return sar.coherence(fx.slc(spark, d, 0), fx.slc(spark, d, 1), sar.gaussian(1.0), *_size(spark, d)).select("r", "c", r6("coh"))


@query(_window_sql(2, "0.04::DOUBLE"))
def coherence_tiled(spark: S, d: str) -> DataFrame:
    """The same by tiles with their halo, the form for large scenes."""
    importable(spark)
    return kernels.coherence_tiled(fx.slc(spark, d, 0), fx.slc(spark, d, 1), sar.boxcar(5), *_size(spark, d), 64).select("r", "c", r6("coh"))


def _kernel_sql(name: str, n: str) -> str:
    """Upsampling by two of a line of n samples as a matrix over (q, s)."""
    theta = f"(2*pi()*f*(q/2e0 - s)/{n})"
    return f"{name} AS (SELECT q, s, sum(cos{theta})/{n} AS kr, sum(sin{theta})/{n} AS ki FROM range(0, 2*{n}) a(q), range(0, {n}) b(s), range(-({n} // 2), ({n} + 1) // 2) e(f) GROUP BY 1, 2)"


def _up(out: str, source: str, kernel: str, line: str, along: str) -> str:
    return f"{out} AS (SELECT {line}, q AS {along}, sum(re*kr - im*ki) AS re, sum(re*ki + im*kr) AS im FROM {source} JOIN {kernel} ON s = {along} GROUP BY 1, 2)"


_AA = "SELECT {r} AS r, c // 2 AS c, round(avg(x.re*y.re + x.im*y.im), 6) + 0e0 AS re, round(avg(x.im*y.re - x.re*y.im), 6) + 0e0 AS im FROM {x} x JOIN {y} y USING (r, c) GROUP BY 1, 2"


@query(with_sql("a b", "SELECT 1").replace(" SELECT 1", "") + ", " + _kernel_sql("k", "32") + ", " + _up("ua", "a", "k", "r", "c") + ", " + _up("ub", "b", "k", "r", "c") + " " + _AA.format(r="r", x="ua", y="ub"))
def interferogram_aa_range(spark: S, d: str) -> DataFrame:
    importable(spark)
    return kernels.antialiased(fx.slc(spark, d, 0), fx.slc(spark, d, 1)).select("r", "c", r6("re"), r6("im"))


_K2 = [_kernel_sql("k", "32"), _kernel_sql("kk", "250"), *[_up(f"u{x}", x, "k", "r", "c") for x in "ab"], *[_up(f"w{x}", f"u{x}", "kk", "c", "r") for x in "ab"]]


@query(with_sql("a b", "SELECT 1").replace(" SELECT 1", "") + ", " + ", ".join(_K2) + " " + _AA.format(r="r // 2", x="wa", y="wb"))  # 250 lines at the oracle's sizes
def interferogram_aa_2d(spark: S, d: str) -> DataFrame:
    importable(spark)
    return kernels.antialiased(fx.slc(spark, d, 0), fx.slc(spark, d, 1), both_axes=True).select("r", "c", r6("re"), r6("im"))


@query()
def goldstein(spark: S, d: str) -> DataFrame:
    importable(spark)
    return kernels.goldstein(pair(spark, d), 0.5, 16, 4).select("r", "c", r6("re"), r6("im"))


_TURN = "CASE WHEN {d} > pi() THEN -1 WHEN {d} < -pi() THEN 1 ELSE 0 END"
_LAST = "last_value(ph IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    with_sql(
        "p m",
        f"""SELECT r, c, round(ph + (before + sum(turn) OVER (PARTITION BY r ORDER BY c)) * 2 * pi(), 5) + 0e0 AS unw,
        CASE WHEN count(*) OVER () = (max(r) OVER () + 1) * (max(c) OVER () + 1) THEN 1::BIGINT END AS conncomp
        FROM (SELECT r, c, ph, {_TURN.format(d="ph - " + _LAST.format(w="PARTITION BY r ORDER BY c"))} AS turn FROM (SELECT r, c, CASE WHEN mask <> 0 AND mask <> 255 THEN {_ANGLE} END AS ph FROM p JOIN m USING (r, c)))
        JOIN (SELECT r, sum(turn) OVER (ORDER BY r) AS before FROM (SELECT r, {_TURN.format(d="ph - " + _LAST.format(w="ORDER BY r"))} AS turn
        FROM (SELECT r, arg_min(CASE WHEN mask <> 0 AND mask <> 255 THEN {_ANGLE} END, CASE WHEN mask <> 0 AND mask <> 255 THEN c END) AS ph FROM p JOIN m USING (r, c) GROUP BY r))) USING (r)""",
    )
)
def unwrap_rows(spark: S, d: str) -> DataFrame:
    """A masked interferogram; masked samples are NaN. All pixels count as coherent, so a full rectangle is one component."""
    importable(spark)
    x = pair(spark, d).join(fx.mask_gslc(spark, d), ["r", "c"]).withColumn("coh", F.lit(1.0))
    for v in ("re", "im"):
        x = x.withColumn(v, F.when(sar.slc_valid(F.col("mask")), F.col(v)).otherwise(F.lit(float("nan"))))
    return kernels.unwrap(x).select("r", "c", (F.round(F.when(~F.isnan("unw"), F.col("unw")), 5) + 0.0).alias("unw"), "conncomp")


@query(
    with_sql(
        "s",
        """SELECT i, j, round(CASE WHEN w > 0 THEN re/w ELSE 0e0 END, 6) + 0e0 AS re, round(CASE WHEN w > 0 THEN im/w ELSE 0e0 END, 6) + 0e0 AS im FROM (
        SELECT x.t AS i, y.t AS j, sum(x.re*y.re + x.im*y.im) AS re, sum(x.im*y.re - x.re*y.im) AS im, sqrt(sum(x.re*x.re + x.im*x.im)*sum(y.re*y.re + y.im*y.im)) AS w
        FROM s x JOIN s y USING (r, c) GROUP BY 1, 2)""",
    )
)
def coherence_matrix(spark: S, d: str) -> DataFrame:
    return kernels.coherence_elements(fx.stack(spark, d)).select("i", "j", r6("re"), r6("im"))


@query()
def emi(spark: S, d: str) -> DataFrame:
    importable(spark)
    return kernels.emi(fx.stack(spark, d)).select("t", r6("phase", 5))


@query(with_sql("s", "SELECT r, c, round(sum(re*re + im*im)/10, 6) AS var FROM s GROUP BY 1, 2"))
def amp_variance(spark: S, d: str) -> DataFrame:
    return _variance(spark, d).select("r", "c", r6("var"))


def _variance(spark: S, d: str) -> DataFrame:
    return fx.stack(spark, d).groupBy("r", "c").agg((F.sum(F.expr("re*re + im*im")) / 10).alias("var"))


def _glrt(p: str, s: str) -> str:
    return f"CASE WHEN {p} > 0 AND {s} > 0 THEN 2*ln(({p} + {s})/2) - ln({p}) - ln({s}) < {stages.num(kernels.chi2_1(0.95) / 10)} ELSE FALSE END"


_VAR = "w AS (SELECT r, c, sum(re*re + im*im)/10 AS var FROM s GROUP BY 1, 2)"


@query(with_sql("s", "SELECT 1").replace(" SELECT 1", f", {_VAR} SELECT r, c, {_glrt('var', 'o')} AS similar FROM w, (SELECT var AS o FROM w WHERE r = 0 AND c = 0)"))
def identify_shp(spark: S, d: str) -> DataFrame:
    """Each pixel against the first one."""
    w = _variance(spark, d)
    first = w.where("r = 0 and c = 0").select(F.col("var").alias("o"))
    return w.crossJoin(F.broadcast(first)).select("r", "c", F.expr(_glrt("var", "o")).alias("similar"))


@query(
    with_sql("s", "SELECT 1").replace(
        " SELECT 1", f", {_VAR} SELECT x.r, x.c, count(*) AS n FROM w x, range(-2, 3) a(dr), range(-2, 3) b(dc), w y WHERE y.r = x.r + dr AND y.c = x.c + dc AND {_glrt('x.var', 'y.var')} GROUP BY 1, 2"
    )
)
def shp_count(spark: S, d: str) -> DataFrame:
    """Similar pixels in the 5 by 5 window: each pixel is sent to the pixels whose window holds it."""
    w = _variance(spark, d)
    near = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    sent = w.select("r", "c", F.col("var").alias("o"), near.alias("dr")).select("*", near.alias("dc"))
    sent = sent.select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "o")
    return w.join(sent, ["r", "c"]).where(F.expr(_glrt("var", "o"))).groupBy("r", "c").agg(F.count("*").alias("n"))


@query()
def phase_link(spark: S, d: str) -> DataFrame:
    importable(spark)
    linked = kernels.phase_link(fx.stack(spark, d), tile=16)
    return linked.select("t", "r", "c", r6("re", 4), r6("im", 4), r6("coh", 4))


# projections and masks


@query(with_sql("a m", "SELECT r, c, mask <> 0 AND mask <> 255 AS valid, round(CASE WHEN mask <> 0 AND mask <> 255 THEN re END, 6) + 0e0 AS re, round(CASE WHEN mask <> 0 AND mask <> 255 THEN im END, 6) + 0e0 AS im FROM a JOIN m USING (r, c)"))
def get_slc_masked(spark: S, d: str) -> DataFrame:
    """Masked samples are NaN in the engine; the query shows them as null beside a flag."""
    images, masks = (x.withColumn("frequency", F.lit("frequencyA")) for x in (fx.slc(spark, d, 0).withColumn("polarization", F.lit("HH")), fx.mask_gslc(spark, d)))
    x = selection.get_slc(images, "HH", "A", masks, "GSLC")
    return x.select("r", "c", (~F.isnan("re")).alias("valid"), *[(F.round(F.when(~F.isnan(v), F.col(v)), 6) + 0.0).alias(v) for v in ("re", "im")])


_GUNW = "(mask // 10) % 10 <> 0 AND mask % 10 <> 0 AND mask <> 255"


@query(with_sql("ph g", f"SELECT r, c, {_GUNW} AS valid, round(CASE WHEN {_GUNW} THEN unw END, 6) + 0e0 AS unw FROM ph JOIN g USING (r, c)"))
def get_gunw_masked(spark: S, d: str) -> DataFrame:
    bands, masks = (x.withColumns({"frequency": F.lit("frequencyA"), "layer": F.lit("unwrappedInterferogram"), "polarization": F.lit("HH")}) for x in (fx.phases(spark, d), fx.mask_gunw(spark, d)))
    x = selection.get_gunw(bands, "unw", masks=masks, product_type="GUNW")
    return x.select("r", "c", (~F.isnan("unw")).alias("valid"), (F.round(F.when(~F.isnan("unw"), F.col("unw")), 6) + 0.0).alias("unw"))


@query(with_sql("a m", "SELECT r, c, round(CASE WHEN mask = 3 THEN re ELSE -1e0 END, 6) + 0e0 AS re FROM a JOIN m USING (r, c)"))
def apply_mask(spark: S, d: str) -> DataFrame:
    return sar.apply_mask(fx.slc(spark, d, 0).join(fx.mask_gslc(spark, d), ["r", "c"]), "re", "mask", 3, -1.0).select("r", "c", r6("re"))


@query(with_sql("a m", "SELECT r, c, round(20*log10(sqrt(re*re + im*im)), 5) + 0e0 AS db FROM a JOIN m USING (r, c) WHERE mask <> 0 AND mask <> 255 AND re*re + im*im > 0"))
def gslc_amplitude_db(spark: S, d: str) -> DataFrame:
    x = fx.slc(spark, d, 0).join(fx.mask_gslc(spark, d).where(sar.slc_valid(F.col("mask"))), ["r", "c"]).where("re*re + im*im > 0")
    return x.select("r", "c", sar.to_db(F.sqrt(F.expr("re*re + im*im")), power=False).alias("db")).select("r", "c", r6("db", 5))


@query(with_sql("p ph", "SELECT r, c, round(unw, 6) + 0e0 AS unwrapped_phase, round(cos(atan2(im, re)), 6) + 0e0 AS wrapped_cos, round(iono, 6) + 0e0 AS ionosphere FROM p JOIN ph USING (r, c)"))
def gunw_bands(spark: S, d: str) -> DataFrame:
    """Bands as they are, without the mask."""
    x = pair(spark, d).join(fx.phases(spark, d), ["r", "c"])
    return x.select("r", "c", (F.round("unw", 6) + 0.0).alias("unwrapped_phase"), (F.round(F.cos(sar.phase(F.col("re"), F.col("im"))), 6) + 0.0).alias("wrapped_cos"), (F.round("iono", 6) + 0.0).alias("ionosphere"))


@query(with_sql("a", "SELECT r, c, round(10*log10(re*re + im*im), 5) + 0e0 AS power_db, round(20*log10(abs(re)), 5) + 0e0 AS amp_db FROM a WHERE re <> 0"))
def to_db(spark: S, d: str) -> DataFrame:
    x = fx.slc(spark, d, 0).where("re <> 0")
    return x.select("r", "c", sar.to_db(F.expr("re*re + im*im")).alias("power_db"), sar.to_db(F.col("re"), power=False).alias("amp_db")).select("r", "c", r6("power_db", 5), r6("amp_db", 5))


@query(with_sql("a", "SELECT r, c, round(pow(10e0, re/10e0), 6) AS power, round(pow(10e0, re/20e0), 6) AS amp FROM a"))
def from_db(spark: S, d: str) -> DataFrame:
    x = fx.slc(spark, d, 0)
    return x.select("r", "c", sar.from_db(F.col("re")).alias("power"), sar.from_db(F.col("re"), power=False).alias("amp")).select("r", "c", r6("power"), r6("amp"))


@query(with_sql("a", "SELECT r, c, round(re, 6) + 0e0 AS v_real, round(im, 6) + 0e0 AS v_imag FROM a"))
def complex_split(spark: S, d: str) -> DataFrame:
    return fx.slc(spark, d, 0).select("r", "c", (F.round("re", 6) + 0.0).alias("v_real"), (F.round("im", 6) + 0.0).alias("v_imag"))


@query(with_sql("a b", "SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, round(a.re, 6) + 0e0 AS re, round(b.im, 6) + 0e0 AS im, a.re IS NULL OR b.im IS NULL AS orphan FROM a FULL JOIN (SELECT * FROM b WHERE c < 30) b ON a.r = b.r AND a.c = b.c"))
def complex_merge(spark: S, d: str) -> DataFrame:
    """Real and imaginary variables merged; a part without its other is an orphan and passes through."""
    x = fx.slc(spark, d, 0).select("r", "c", "re").join(fx.slc(spark, d, 1).where("c < 30").select("r", "c", "im"), ["r", "c"], "full")
    return x.select("r", "c", r6("re"), r6("im"), F.expr("re is null or im is null").alias("orphan"))


@query(with_sql("a m", "SELECT r, c, round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im FROM a JOIN m USING (r, c) WHERE r BETWEEN 10 AND 60 AND c BETWEEN 4 AND 20 AND mask <> 0 AND mask <> 255"))
def crop_gslc(spark: S, d: str) -> DataFrame:
    box = "r between 10 and 60 and c between 4 and 20"
    x = fx.slc(spark, d, 0).where(box).join(fx.mask_gslc(spark, d).where(box).where(sar.slc_valid(F.col("mask"))), ["r", "c"])
    return x.select("r", "c", r6("re"), r6("im"))


# polarimetry


@query("SELECT r, c, " + ", ".join(f"round({p}, 5) + 0e0 AS {p}" for p in pol.PRODUCTS) + " FROM " + stages.sql("(" + with_sql("q", "SELECT * FROM q") + ")", pol.COVARIANCE))
def covariance_elements(spark: S, d: str) -> DataFrame:
    return stages.apply(fx.quadpol(spark, d), pol.COVARIANCE).select("r", "c", *[r6(p, 5) for p in pol.PRODUCTS])


_T = list(pol.T3[0])


@query("SELECT r, c, " + ", ".join(f"round({t}, 5) + 0e0 AS {t}" for t in _T) + " FROM " + stages.sql("(" + with_sql("q", "SELECT * FROM q") + ")", pol.COVARIANCE + pol.T3))
def t3_matrix(spark: S, d: str) -> DataFrame:
    return stages.apply(fx.quadpol(spark, d), pol.COVARIANCE + pol.T3).select("r", "c", *[r6(t, 5) for t in _T])


_LOOKED = (
    "(SELECT r // 4 AS lr, c // 4 AS lc, "
    + ", ".join(f"avg({p}) AS {p}" for p in pol.PRODUCTS)
    + " FROM "
    + stages.sql("(" + with_sql("q", "SELECT * FROM q") + ")", pol.COVARIANCE)
    + " WHERE r < ((SELECT max(vec_id) + 1 FROM embeddings) // 3) // 4 * 4 GROUP BY 1, 2)"
)
_EIG = pol.T3 + pol.EIGEN + pol.MINOR


def _looked(spark: S, d: str) -> DataFrame:
    x = stages.apply(fx.quadpol(spark, d), pol.COVARIANCE)
    return stages.apply(sar.multilook(x, pol.PRODUCTS, 4, 4, *_size(spark, d, 3)), _EIG)


def _pol_sql(**columns: str) -> str:
    return "SELECT lr, lc, " + ", ".join(f"round({e}, 5) + 0e0 AS {n}" for n, e in columns.items()) + " FROM " + stages.sql(_LOOKED, _EIG)


def _pol(spark: S, d: str, **columns: str) -> DataFrame:
    return _looked(spark, d).select("lr", "lc", *[(F.round(F.expr(e), 5) + 0.0).alias(n) for n, e in columns.items()])


@query(_pol_sql(t1="t1", t2="t2", t3="t3"))
def t3_eigenvalues(spark: S, d: str) -> DataFrame:
    return _pol(spark, d, t1="t1", t2="t2", t3="t3")


@query(_pol_sql(entropy=pol.ENTROPY))
def entropy(spark: S, d: str) -> DataFrame:
    return _pol(spark, d, entropy=pol.ENTROPY)


@query(_pol_sql(anisotropy=pol.ANISOTROPY))
def anisotropy(spark: S, d: str) -> DataFrame:
    return _pol(spark, d, anisotropy=pol.ANISOTROPY)


@query("SELECT r, c, round(" + pol.SINGLE_LOOK_ALPHA + ", 4) + 0e0 AS alpha FROM " + stages.sql("(" + with_sql("q", "SELECT * FROM q") + ")", pol.COVARIANCE + pol.T3))
def alpha(spark: S, d: str) -> DataFrame:
    x = stages.apply(fx.quadpol(spark, d), pol.COVARIANCE + pol.T3)
    return x.select("r", "c", (F.round(F.expr(pol.SINGLE_LOOK_ALPHA), 4) + 0.0).alias("alpha"))


@query(_pol_sql(mean_alpha=pol.MEAN_ALPHA))
def mean_alpha(spark: S, d: str) -> DataFrame:
    return _pol(spark, d, mean_alpha=pol.MEAN_ALPHA)


_ALL = {"entropy": pol.ENTROPY, "anisotropy": pol.ANISOTROPY, "alpha": pol.ALPHA, "mean_alpha": pol.MEAN_ALPHA}


@query(_pol_sql(**_ALL))
def h_a_alpha(spark: S, d: str) -> DataFrame:
    return _pol(spark, d, **_ALL)


# summaries


@query(
    with_sql(
        "a",
        """SELECT count(*) FILTER (WHERE ok) AS n, count(*) AS total, round(count(*) FILTER (WHERE ok)/count(*)::DOUBLE, 6) AS fraction, round(min(x) FILTER (WHERE ok), 6) AS lo, round(max(x) FILTER (WHERE ok), 6) AS hi, round(avg(x) FILTER (WHERE ok), 6) + 0e0 AS mean,
        round(quantile_cont(x, 0.5) FILTER (WHERE ok), 6) + 0e0 AS median, round(quantile_cont(x, 0.25) FILTER (WHERE ok), 6) + 0e0 AS q25, round(quantile_cont(x, 0.75) FILTER (WHERE ok), 6) + 0e0 AS q75 FROM (SELECT re AS x, isfinite(re) AS ok FROM a)""",
    )
)
def array_stats(spark: S, d: str) -> DataFrame:
    return stats(fx.slc(spark, d, 0), "re")


def stats(px: DataFrame, value: str) -> DataFrame:
    """Count, range, mean and exact quartiles of the finite values, rounded."""
    a = selection.array_stats(px, value)
    return a.select("n", "total", *[F.round(v, 6).alias(v) for v in ("fraction", "lo", "hi")], *[r6(v) for v in ("mean", "median", "q25", "q75")])


@query(with_sql("m", "SELECT count(*) FILTER (WHERE mask <> 0) AS valid, count(*) AS total, round(count(*) FILTER (WHERE mask <> 0)/count(*)::DOUBLE, 6) AS fraction FROM m"))
def mask_coverage(spark: S, d: str) -> DataFrame:
    """Nonzero counts as valid, fill included."""
    a = fx.mask_gslc(spark, d).agg(F.count_if(F.col("mask") != 0).alias("valid"), F.count("*").alias("total"))
    return a.select("valid", "total", F.round(F.col("valid") / F.col("total").cast("double"), 6).alias("fraction"))


@query(with_sql("cc", "SELECT count(*) AS n_components, max(n) AS largest_size, arg_min(label, -n*1000 + label) AS largest_label, round(max(n)/(SELECT count(*) FROM cc)::DOUBLE, 6) AS largest_fraction, round(sum(n)/(SELECT count(*) FROM cc)::DOUBLE, 6) AS valid_fraction FROM (SELECT label, count(*) AS n FROM cc WHERE label > 0 GROUP BY 1)"))
def conncomp_stats(spark: S, d: str) -> DataFrame:
    cc = fx.conncomp(spark, d)
    sizes = cc.groupBy("label").agg(F.count("*").alias("n"))
    sums = sizes.agg(F.sum("n").alias("total"), F.count_if(F.col("label") > 0).alias("n_components"), F.max(F.when(F.col("label") > 0, F.struct("n", (-F.col("label")).alias("l")))).alias("top"), F.sum(F.when(F.col("label") > 0, F.col("n"))).alias("valid"))
    total = F.col("total").cast("double")
    return sums.select("n_components", F.col("top.n").alias("largest_size"), (-F.col("top.l")).alias("largest_label"), F.round(F.col("top.n") / total, 6).alias("largest_fraction"), F.round(F.col("valid") / total, 6).alias("valid_fraction"))


@query(with_sql("ph", "SELECT count(*) AS n, round(corr(unw, iono), 6) AS pearson, round(sqrt(avg((unw - iono)*(unw - iono))), 6) AS rmse, round(1 - sum((unw - iono)*(unw - iono))/sum((unw - m)*(unw - m)), 6) AS r2 FROM ph, (SELECT avg(unw) AS m FROM ph)"))
def fit_metrics(spark: S, d: str) -> DataFrame:
    """Pearson r, RMSE and R2 of iono against unw over jointly finite pixels."""
    return selection.fit_metrics(fx.phases(spark, d), "unw", "iono").select("n", r6("pearson"), F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


_CENTRED = "(SELECT unw - (SELECT median(unw) FROM ph) AS unw, iono - (SELECT median(iono) FROM ph) AS iono FROM ph)"


@query(with_sql("ph", f"SELECT count(*) AS n, round(corr(unw, iono), 6) AS pearson, round(sqrt(avg((unw - iono)*(unw - iono))), 6) AS rmse, round(1 - sum((unw - iono)*(unw - iono))/sum((unw - m)*(unw - m)), 6) AS r2 FROM {_CENTRED}, (SELECT avg(unw) AS m FROM {_CENTRED})"))
def fit_metrics_centred(spark: S, d: str) -> DataFrame:
    """The same after each lost its median."""
    return selection.fit_metrics(fx.phases(spark, d), "unw", "iono", centred=True).select("n", r6("pearson"), F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(with_sql("ph", "SELECT count(*) AS n, round(avg(unw - iono), 6) AS mean, round(stddev_pop(unw - iono), 6) AS std, round(sqrt(avg((unw - iono)*(unw - iono))), 6) AS rms FROM ph"))
def residual_summary(spark: S, d: str) -> DataFrame:
    x = fx.phases(spark, d).select(F.expr("unw - iono").alias("x"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.round(F.sqrt(F.avg(F.expr("x*x"))), 6).alias("rms"))


@query(with_sql("ph", "SELECT round(sqrt(avg(cos(unw - iono))*avg(cos(unw - iono)) + avg(sin(unw - iono))*avg(sin(unw - iono))), 6) AS corr, round(avg(atan2(sin(unw - iono), cos(unw - iono))), 6) AS bias, round(stddev_pop(atan2(sin(unw - iono), cos(unw - iono))), 6) AS std FROM ph"))
def phase_agreement(spark: S, d: str) -> DataFrame:
    x = fx.phases(spark, d).select(F.expr("cos(unw - iono)").alias("a"), F.expr("sin(unw - iono)").alias("b"))
    w = F.atan2("b", "a")
    return x.agg(F.round(F.sqrt(F.avg("a") * F.avg("a") + F.avg("b") * F.avg("b")), 6).alias("corr"), F.round(F.avg(w), 6).alias("bias"), F.round(F.stddev_pop(w), 6).alias("std"))


@query(
    with_sql(
        "p",
        "SELECT count(*) AS n, round(quantile_cont(x, 0.5), 6) AS median, round(avg(x), 6) AS mean, round(stddev_pop(x), 5) AS std, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.95), 6) AS p95 FROM (SELECT sqrt(re1*re1 + im1*im1)/sqrt(re2*re2 + im2*im2) AS x FROM p WHERE re1*re1 + im1*im1 > 0 AND re2*re2 + im2*im2 > 0)",
    )
)
def amp_ratio(spark: S, d: str) -> DataFrame:
    x = pair(spark, d).where("re1*re1 + im1*im1 > 0 and re2*re2 + im2*im2 > 0").select(F.expr("sqrt(re1*re1 + im1*im1)/sqrt(re2*re2 + im2*im2)").alias("x"))
    a = x.agg(F.count("*").alias("n"), F.percentile("x", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("q"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 5).alias("std"))
    return a.select("n", F.round(F.get("q", F.lit(0)), 6).alias("median"), "mean", "std", F.round(F.get("q", F.lit(1)), 6).alias("p5"), F.round(F.get("q", F.lit(2)), 6).alias("p95"))


@query(with_sql("ph", "SELECT round(min(unw), 6) AS lo, round(max(unw), 6) AS hi, max(unw) - min(unw) <= 2*pi() + 0.1 AS wrapped, max(r) + 1 AS ny, max(c) + 1 AS nx FROM ph"))
def plot_stats(spark: S, d: str) -> DataFrame:
    """What a plot needs: value range, whether it is a wrapped phase, and the extent."""
    return fx.phases(spark, d).agg(F.round(F.min("unw"), 6).alias("lo"), F.round(F.max("unw"), 6).alias("hi"), (F.max("unw") - F.min("unw") <= 2 * F.pi() + 0.1).alias("wrapped"), (F.max("r") + 1).alias("ny"), (F.max("c") + 1).alias("nx"))
