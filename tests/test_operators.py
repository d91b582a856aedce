"""Operators against numpy and analytic results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarspark.functions import geodesy as geo
from sarspark.functions import polarimetry as pol
from sarspark.operators import geometry, kernels, sar
from sarspark.plans import stages


def pixels(spark, z):
    rows = [(int(i), int(j), float(z[i, j].real), float(z[i, j].imag)) for i in range(z.shape[0]) for j in range(z.shape[1])]
    return spark.createDataFrame(rows, "r long, c long, re double, im double")


def image(df, shape, *names):
    out = [np.zeros(shape) for _ in names]
    for row in df.collect():
        for o, n in zip(out, names):
            o[row["r"], row["c"]] = row[n]
    return out[0] if len(out) == 1 else out[0] + 1j * out[1]


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(7)
    return rng.normal(size=(2, 12, 16)) + 1j * rng.normal(size=(2, 12, 16))


def test_interferogram_of_a_known_phase(spark, noise):
    a = noise[0]
    z = image(sar.interferogram(pixels(spark, a * np.exp(0.7j)), pixels(spark, a)), a.shape, "re", "im")
    assert np.allclose(np.angle(z), 0.7)


def test_multilook_cuts_the_rest_and_nan_spoils_its_block(spark):
    z = np.arange(35, dtype=float).reshape(5, 7).astype(complex)
    z[0, 0] = np.nan
    got = {(r.lr, r.lc): r.re for r in sar.multilook(pixels(spark, z), ["re"], 2, 3, 5, 7).collect()}
    want = np.real(z[:4, :6]).reshape(2, 2, 2, 3).mean((1, 3))
    assert set(got) == {(i, j) for i in range(2) for j in range(2)}
    assert all(math.isnan(got[k]) if k == (0, 0) else np.isclose(got[k], want[k]) for k in got)
    with pytest.raises(ValueError):
        sar.multilook(pixels(spark, z), ["re"], 0, 1, 5, 7)


@pytest.mark.parametrize("weights", [sar.boxcar(5), sar.gaussian(1.0), sar.boxcar(15), sar.boxcar(27)])
def test_coherence_with_reflected_edges(spark, noise, weights):
    a, b = noise
    h = len(weights) // 2

    def smooth(x):
        for axis in (0, 1):
            p = np.pad(x, [(h, h) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
            x = sum(w * np.take(p, range(k, k + x.shape[axis]), axis) for k, w in enumerate(weights))
        return x

    want = np.abs(smooth(a * b.conj())) / np.sqrt(smooth(np.abs(a) ** 2) * smooth(np.abs(b) ** 2))
    got = image(sar.coherence(pixels(spark, a), pixels(spark, b), weights, *a.shape), a.shape, "coh")
    assert np.allclose(got, np.clip(want, 0, 1), atol=1e-9)


def test_coherence_is_zero_without_power_and_windows_are_checked(spark):
    z = np.zeros((4, 4), complex)
    assert image(sar.coherence(pixels(spark, z), pixels(spark, z), sar.boxcar(3), 4, 4), (4, 4), "coh").max() == 0
    for bad in (lambda: sar.boxcar(4), lambda: sar.boxcar(0), lambda: sar.gaussian(0.5)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("both", [False, True])
def test_antialiased_against_whole_image_fft(spark, noise, both):
    a, b = noise

    def up(z):
        z = kernels.upsample2(z)
        return kernels.upsample2(z.T).T if both else z

    x = up(a) * up(b).conj()
    want = x.reshape(*((12, 2) if both else (12, 1)), 16, 2).mean((1, 3))
    assert np.allclose(image(kernels.antialiased(pixels(spark, a), pixels(spark, b), both), a.shape, "re", "im"), want)


def test_upsampling_keeps_the_samples(noise):
    assert np.allclose(kernels.upsample2(noise[0])[:, ::2], noise[0])
    assert [kernels.fast_length(n) for n in (1, 13, 250, 17)] == [1, 14, 250, 18]


def test_goldstein_against_one_pass(spark):
    rng = np.random.default_rng(3)
    z = np.exp(1j * (0.2 * np.arange(40)[None] + rng.normal(size=(24, 40)) * 0.3))
    patch, overlap, alpha = 16, 4, 0.5
    step, total, weight = 12, np.zeros(z.shape, complex), np.zeros(z.shape)
    win = np.outer(np.hanning(17)[:-1], np.hanning(17)[:-1])
    for r in range(0, 24, step):
        for c in range(0, 40, step):
            cut = z[r : r + patch, c : c + patch]
            full = np.zeros((patch, patch), complex)
            full[: cut.shape[0], : cut.shape[1]] = cut
            f = np.fft.fft2(full)
            p = np.pad(np.abs(f), 1, mode="symmetric")
            s = sum(p[i : i + patch, j : j + patch] for i in range(3) for j in range(3)) / 9
            out = np.fft.ifft2(f * s**alpha)[: cut.shape[0], : cut.shape[1]]
            w = win[: cut.shape[0], : cut.shape[1]]
            total[r : r + patch, c : c + patch] += out * w
            weight[r : r + patch, c : c + patch] += w
    want = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)
    got = image(kernels.goldstein(pixels(spark, z), alpha, patch, overlap), z.shape, "re", "im")
    assert np.allclose(got, want, atol=1e-8) and np.allclose(got[0], 0)


def test_emi_finds_known_phases():
    truth = np.array([0.0, 0.5, 1.0, -0.7, 2.0])
    phasor = np.exp(1j * truth)
    got = kernels.emi_phases(0.7 * np.outer(phasor, phasor.conj()) + 0.3 * np.eye(5))
    assert np.allclose(np.angle(np.exp(1j * (got - truth))), 0, atol=0.15)
    assert kernels.chi2_1(0.95) == pytest.approx(3.841458820694124)


def test_phase_link_of_a_ramp_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(5)
    z = np.exp(0.5j * np.arange(5))[:, None, None] * (1 + 0.05 * rng.normal(size=(5, 10, 11)))
    rows = [(t, i, j, float(z[t, i, j].real), float(z[t, i, j].imag)) for t in range(5) for i in range(10) for j in range(11)]
    stack = spark.createDataFrame(rows, "t long, r long, c long, re double, im double")
    whole = {(x.t, x.r, x.c): (x.re, x.im) for x in kernels.phase_link(stack, 2, tile=64).collect()}
    tiles = {(x.t, x.r, x.c): (x.re, x.im) for x in kernels.phase_link(stack, 2, tile=4).collect()}
    assert len(whole) == 550 and whole.keys() == tiles.keys()
    assert all(np.allclose(whole[k], tiles[k]) for k in whole)
    d = [np.angle(complex(*whole[(t, 5, 5)]) * np.conj(complex(*whole[(0, 5, 5)]))) - np.angle(np.exp(0.5j * t)) for t in range(5)]
    assert np.allclose(d, 0, atol=0.3)


def slow_link(z, half):
    """The linked samples and coherences of (t, r, c) by a plain loop over pixels and their windows."""
    n, h, w = z.shape
    power = (np.abs(z) ** 2).sum(0) / (2 * n)
    linked, coh = z.copy(), np.zeros(z.shape)
    for i in range(h):
        for j in range(w):
            alike = lambda a, b: 2 * math.log((power[a, b] + power[i, j]) / 2) - math.log(power[a, b]) - math.log(power[i, j]) < 3.841458820694124 / (2 * n)
            found, todo = {(i, j)}, [(i, j)]
            while todo:
                y, x = todo.pop()
                for a in range(max(y - 1, i - half, 0), min(y + 2, i + half + 1, h)):
                    for b in range(max(x - 1, j - half, 0), min(x + 2, j + half + 1, w)):
                        if (a, b) not in found and alike(a, b):
                            found.add((a, b))
                            todo.append((a, b))
            if len(found) > 1:
                s = np.array([z[:, a, b] for a, b in sorted(found)]).T
                c = np.array([[(x * y.conj()).sum() / math.sqrt((np.abs(x) ** 2).sum() * (np.abs(y) ** 2).sum()) for y in s] for x in s])
                linked[:, i, j], coh[:, i, j] = np.abs(s).mean(1) * np.exp(1j * kernels.emi_phases(c)), np.abs(c[0])
    return linked, coh


def test_phase_link_searches_eleven_pixels_to_each_side(spark):
    rng = np.random.default_rng(11)
    z = np.exp(0.5j * np.arange(3))[:, None, None] * (rng.normal(size=(26, 27)) + 1j * rng.normal(size=(26, 27)))
    z = z + 0.3 * (rng.normal(size=z.shape) + 1j * rng.normal(size=z.shape))
    rows = [(t, i, j, float(z[t, i, j].real), float(z[t, i, j].imag)) for t, i, j in np.ndindex(*z.shape)]
    got = kernels.phase_link(spark.createDataFrame(rows, "t long, r long, c long, re double, im double"), tile=16).collect()
    linked, coh = slow_link(z, 11)
    assert len(got) == z.size
    assert all(np.isclose(complex(x.re, x.im), linked[x.t, x.r, x.c]) and np.isclose(x.coh, coh[x.t, x.r, x.c]) for x in got)


def test_phase_link_keeps_times_and_missing_acquisitions(spark):
    rng = np.random.default_rng(2)
    z = np.exp(0.5j * np.array([2, 5, 9]))[:, None, None] * (1 + 0.05 * rng.normal(size=(3, 8, 20)))
    times = (2, 5, 9)
    rows = [(times[t], i, j, float(z[t, i, j].real), float(z[t, i, j].imag)) for t, i, j in np.ndindex(*z.shape) if not (t == 1 and j >= 8)]
    schema = "t int, r long, c long, re double, im double"
    got = kernels.phase_link(spark.createDataFrame(rows, schema), 2, tile=4).collect()
    assert sorted((x.t, x.r, x.c) for x in got) == sorted(x[:3] for x in rows)
    by = {(x.t, x.r, x.c): complex(x.re, x.im) for x in got}
    for t in (5, 9):  # without the date that tiles from column 12 on lack, even in their halo
        step = [np.angle(by[t, r, c] * np.conj(by[2, r, c]) * np.exp(-0.5j * (t - 2))) for r in range(8) for c in range(20) if (t, r, c) in by]
        assert np.allclose(step, 0, atol=0.3)
    alone = {(x.t, x.r, x.c): complex(x.re, x.im) for x in kernels.phase_link(spark.createDataFrame([x for x in rows if x[2] >= 8], schema), 2, tile=4).collect()}
    assert all(np.isclose(by[k], alone[k]) for k in alone if k[2] >= 12)


def test_linked_windows_do_not_depend_on_the_step(monkeypatch):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(4, 12, 13)) + 1j * rng.normal(size=(4, 12, 13))
    z[:, 3:5, 3:5] = 0
    whole = kernels.link_tile(z, 2, 10, 1, 13, 3, 0.4)
    monkeypatch.setattr(kernels, "LINK_SAMPLES", 1000)
    assert all(np.allclose(a, b) for a, b in zip(whole, kernels.link_tile(z, 2, 10, 1, 13, 3, 0.4)))


def test_unwrap_goes_past_masked_pixels(spark):
    ramp = 0.6 * np.arange(9)[:, None] + 0.6 * np.arange(20)[None]
    z = np.exp(1j * ramp)
    z[4, 5] = z[0, 0] = z[2, 0] = z[2, 1] = z[6, 19] = complex("nan")
    z[7] = complex("nan")
    rows = kernels.unwrap(pixels(spark, z).withColumn("coh", F.lit(1.0))).collect()
    assert len(rows) == z.size
    off = {round((r.unw - ramp[r.r, r.c]) / (2 * math.pi), 9) for r in rows if not np.isnan(z[r.r, r.c])}
    assert off == {0.0} and all(math.isnan(r.unw) == bool(np.isnan(z[r.r, r.c])) for r in rows)
    assert all(math.isnan(r.unw) for r in kernels.unwrap(pixels(spark, np.full((2, 2), complex("nan"))).withColumn("coh", F.lit(1.0))).collect())


def test_components_across_many_tiles(spark):
    rng = np.random.default_rng(9)
    good = rng.random((40, 37)) < 0.58
    rows = [(i, j, bool(good[i, j])) for i, j in np.ndindex(*good.shape)]
    want = kernels.labels(good)
    got = kernels.connected(spark.createDataFrame(rows, "r int, c int, ok boolean"), 5).collect()
    assert all(r.conncomp == want[r.r, r.c] for r in got) and len(got) == good.size


def test_unwrap_recovers_a_ramp(spark):
    ramp = 0.9 * np.arange(10)[:, None] + 0.4 * np.arange(30)[None]
    px = pixels(spark, np.exp(1j * ramp)).withColumn("coh", F.when(F.col("c") == 15, 0.0).otherwise(1.0))
    rows = kernels.unwrap(px, 0.5).collect()
    assert all(abs(r.unw - ramp[r.r, r.c]) < 1e-9 for r in rows)
    assert {r.conncomp for r in rows} == {0, 1, 2}


def test_unwrap_of_noise_against_numpy(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(23, 31)) + 1j * rng.normal(size=(23, 31))
    good = rng.random((23, 31)) < 0.6
    rows = [(i, j, float(z[i, j].real), float(z[i, j].imag), 1.0 if good[i, j] else [0.0, None, float("nan")][(i + j) % 3]) for i in range(23) for j in range(31)]
    px = spark.createDataFrame(rows, "r int, c int, re double, im double, coh double")
    want = np.angle(z)
    want[:, 0] = np.unwrap(want[:, 0])
    want, comp = np.unwrap(want, axis=1), kernels.labels(good)
    for tile in (4, 64):
        got = kernels.unwrap(px, 0.5, tile).collect()
        assert len(got) == z.size
        assert all(abs(r.unw - want[r.r, r.c]) < 1e-9 and r.conncomp == comp[r.r, r.c] for r in got)
    assert kernels.unwrap(px.limit(0)).count() == 0
    assert {r.conncomp for r in kernels.unwrap(px, 2.0).collect()} == {0}


def test_eigenvalues_and_angles_against_numpy(spark):
    rng = np.random.default_rng(11)
    k = rng.normal(size=(4, 6, 3)) + 1j * rng.normal(size=(4, 6, 3))  # looks, pixels, (hh, hv, vv)
    rows = [(p, *[x for v in k[q, p] for x in (float(v.real), float(v.imag))]) for q in range(4) for p in range(6)]
    df = spark.createDataFrame(rows, "p int, hh_re double, hh_im double, hv_re double, hv_im double, vv_re double, vv_im double")
    mean = stages.apply(df, pol.COVARIANCE).groupBy("p").agg(*[F.avg(c).alias(c) for c in pol.PRODUCTS])
    out = stages.apply(mean, pol.T3 + pol.EIGEN + pol.MINOR).select("p", "t1", "t2", "t3", F.expr(pol.ENTROPY).alias("h"), F.expr(pol.ALPHA).alias("a"), F.expr(pol.MEAN_ALPHA).alias("m"))
    for r in out.collect():
        v = np.stack([k[:, r.p, 0] + k[:, r.p, 2], k[:, r.p, 0] - k[:, r.p, 2], 2 * k[:, r.p, 1]]) / np.sqrt(2)
        t = (v @ v.conj().T / 4).conj()
        w, e = np.linalg.eigh(t)
        w, e = w[::-1], e[:, ::-1]
        alphas = np.degrees(np.arccos(np.abs(e[0])))
        share = w / w.sum()
        assert np.allclose([r.t1, r.t2, r.t3], w) and np.isclose(r.a, alphas[0]) and np.isclose(r.m, share @ alphas)
        assert np.isclose(r.h, -(share * np.log(share)).sum() / np.log(3))


def test_utm_round_trip_and_a_known_point(spark):
    df = spark.createDataFrame([(-117.0, 36.1), (-120.0, 0.0), (-115.5, -33.0), (9.0, 48.0)], "lon double, lat double")
    there = stages.apply(df.where("lon < 0"), geo.lonlat_to_utm(32611)).select(F.col("lon").alias("a"), F.col("lat").alias("b"), "east", "north")
    back = stages.apply(there, geo.utm_to_lonlat(32611, "east", "north")).collect()
    assert len(back) == 3 and all(abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9 for r in back)
    middle = stages.apply(df.where("lon > 0"), geo.lonlat_to_utm(32632)).first()
    assert middle.east == pytest.approx(500000) and middle.north == pytest.approx(5316300.0, abs=500)
    ecef = stages.apply(df.limit(1).withColumn("h", F.lit(0.0)).withColumn("lon", F.lit(0.0)).withColumn("lat", F.lit(0.0)), geo.lonlat_to_ecef()).first()
    assert (ecef.ex, ecef.ey, ecef.ez) == pytest.approx((6378137.0, 0.0, 0.0))
    with pytest.raises(ValueError):
        geo.utm_to_lonlat(3857)


def test_spline_is_exact_for_cubics(spark):
    t = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    y = 1 + t - 2 * t**2 + 0.5 * t**3
    df = geometry.orbit_at(spark.createDataFrame([(x,) for x in (0.0, 0.3, 2.5, 6.9, 7.0, 8.0)], "t double"), "t", t, {"y": y})
    assert all(abs(r.y - (1 + r.t - 2 * r.t**2 + 0.5 * r.t**3)) < 1e-9 for r in df.collect())


def test_cube_outside_is_nan_and_linear_inside(spark):
    cube = spark.createDataFrame([(k, j, i, float(k + 2 * j + 3 * i)) for k in range(2) for j in range(3) for i in range(4)], "k long, j long, i long, v double")
    px = spark.createDataFrame([(0.5, 1.25, 2.75), (1.0, 2.0, 3.0), (1.1, 0.0, 0.0), (0.0, -0.1, 0.0)], "a double, b double, d double")
    got = [r.v for r in geometry.interpolate_cube(px, cube, "v", F.col("a"), F.col("b"), F.col("d"), (2, 3, 4)).collect()]
    assert got[:2] == pytest.approx([0.5 + 2.5 + 8.25, 1 + 4 + 9]) and all(map(math.isnan, got[2:]))


def test_db_round_trip_and_zero(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (-3.0,)], "x double")
    got = [r.x for r in df.select(sar.to_db(F.col("x")).alias("x")).collect()]
    assert got[0] == -math.inf and got[1] == pytest.approx(3.0103, abs=1e-4)
    back = df.where("x > 0").select(sar.from_db(sar.to_db(F.col("x"), False), False).alias("x")).first().x
    assert back == pytest.approx(2.0)


def test_masks(spark):
    df = spark.createDataFrame([(m,) for m in (0, 1, 10, 11, 111, 255)], "m int")
    assert [r.v for r in df.select(sar.gunw_valid(F.col("m")).alias("v")).collect()] == [False, False, False, True, True, False]
    assert [r.v for r in df.select(sar.slc_valid(F.col("m")).alias("v")).collect()] == [False, True, True, True, True, False]


@pytest.mark.parametrize(("weights", "tile"), [(sar.boxcar(5), 5), (sar.gaussian(1.0), 4), (sar.boxcar(3), 64)])
def test_tiled_coherence_is_the_windowed_one(spark, noise, weights, tile):
    a, b = (pixels(spark, z) for z in noise)
    want = image(sar.coherence(a, b, weights, 12, 16), (12, 16), "coh")
    assert np.allclose(image(kernels.coherence_tiled(a, b, weights, 12, 16, tile), (12, 16), "coh"), want)
    with pytest.raises(ValueError):
        kernels.coherence_tiled(a, b, sar.boxcar(9), 12, 16, 3)


def test_antialiased_coherence(spark, noise):
    a, b = (pixels(spark, z) for z in noise)
    z = image(kernels.antialiased(a, b, True), (12, 16), "re", "im").reshape(3, 4, 4, 4).mean((1, 3))
    p = [(np.abs(x) ** 2).reshape(3, 4, 4, 4).mean((1, 3)) for x in noise]
    got = {(r.lr, r.lc): r.coh for r in kernels.multilook_coherence(a, b, 4, 4, 12, 16, "2d").collect()}
    assert all(np.isclose(got[i, j], abs(z[i, j]) / np.sqrt(p[0][i, j] * p[1][i, j])) for i in range(3) for j in range(4))
    assert kernels.multilook_coherence(a, b, 4, 4, 12, 16).count() == 12


def test_axes_match(spark):
    axis = spark.createDataFrame([(0, 500000.0), (1, 500030.0)], "idx long, coord double")
    near = axis.withColumn("coord", F.col("coord") * (1 + 1e-10))
    assert geometry.axes_match(axis, near) and not geometry.axes_match(axis, axis.withColumn("coord", F.col("coord") + 1)) and not geometry.axes_match(axis, axis.limit(1))


def test_tiles_give_what_pixels_give(spark, noise):
    from sarspark.operators import tiles

    a, b = (pixels(spark, z) for z in noise)
    ta, tb = (tiles.to_tiles(x, 12, 16, 8) for x in (a, b))
    assert np.allclose(image(tiles.to_pixels(ta, 8), (12, 16), "re", "im"), noise[0], atol=1e-6)
    for looks in ((4, 4), (8, 2)):
        want = {(r.lr, r.lc): (r.re, r.im, r.coh) for r in sar.multilook_coherence(a, b, *looks, 12, 16).collect()}
        got = {(r.lr, r.lc): (r.re, r.im, r.coh) for r in tiles.multilook_coherence(ta, tb, *looks, 12, 16, 8).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)
    with pytest.raises(ValueError):
        tiles.multilook_coherence(ta, tb, 3, 4, 12, 16, 8)
