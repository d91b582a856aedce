"""Tile kernels for what DataFrame functions cannot say: FFT, adaptive filtering, phase linking, unwrapping.

Each runs grouped by an explicit key (a line, a patch, a tile with its halo), so memory is that of
one group, and the SQL around it does the rest.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Written
from .components import components


def fast_length(n: int) -> int:
    """The least length of at least n whose prime factors are at most 11."""
    while True:
        m = n
        for p in (2, 3, 5, 7, 11):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def upsample2(z: np.ndarray) -> np.ndarray:
    """Twice as many samples along the last axis by padding the spectrum; cut to the input's span."""
    n = z.shape[-1]
    size = fast_length(n)
    spectrum = np.fft.fft(z, size, axis=-1)
    low = (size + 1) // 2
    wide = np.zeros((*z.shape[:-1], 2 * size), complex)
    wide[..., :low] = spectrum[..., :low]
    wide[..., 2 * size - (size - low) :] = spectrum[..., low:]
    return 2 * np.fft.ifft(wide, axis=-1)[..., : 2 * n]


#: Lines that one group of the transform holds.
LINES = 64


def _upsampled(px: DataFrame, line: str, along: str) -> DataFrame:
    """Each line of (re, im) upsampled by two; ``along`` then counts half samples. Lines go by blocks of LINES."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(g[line].to_numpy(), return_inverse=True)
        z = np.zeros((len(ids), int(g[along].max()) + 1), complex)
        z[at, g[along].to_numpy()] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
        z = upsample2(z)
        return pd.DataFrame({line: np.repeat(ids, z.shape[1]), along: np.tile(np.arange(z.shape[1]), len(ids)), "re": z.real.ravel(), "im": z.imag.ravel()})

    return px.select(line, along, "re", "im").groupBy(F.expr(f"{line} div {LINES}")).applyInPandas(run, f"{line} long, {along} long, re double, im double")


def antialiased(a: DataFrame, b: DataFrame, both_axes: bool = False) -> DataFrame:
    """(r, c, re, im): interferogram of upsampled images, averaged back; lines are transformed apart.

    The two-axis form upsamples rows, then columns: the transform is separable, so no whole image
    is needed in one place.
    """
    from .sar import interferogram

    ups = []
    for px in (a, b):
        up = _upsampled(px, "r", "c")
        ups.append(_upsampled(up, "c", "r") if both_axes else up)
    z = interferogram(*ups)
    row = F.expr("r div 2") if both_axes else F.col("r")
    return z.groupBy(row.alias("r"), F.expr("c div 2").alias("c")).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def _hann(n: int) -> np.ndarray:
    return np.hanning(n + 1)[:-1]


def _box3(x: np.ndarray) -> np.ndarray:
    """3 by 3 means with symmetric reflection."""
    p = np.pad(x, 1, mode="symmetric")
    return sum(p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)) / 9.0


def goldstein(px: DataFrame, alpha: float = 0.5, patch: int = 32, overlap: int = 8) -> DataFrame:
    """(r, c, re, im) by adaptive spectral filtering of overlapping patches.

    Pixels are copied to the patches that hold them, each patch is filtered, and a second
    aggregate adds the weighted overlaps. Weights are a periodic Hann window, whose first line
    is zero; where no weight falls the result is zero.
    """
    if not 0 <= alpha <= 1 or not 0 <= overlap < patch // 2:
        raise ValueError("alpha must be in [0, 1] and the overlap under half a patch")
    step = patch - overlap
    firsts = lambda c: F.sequence(F.greatest(F.ceil((F.col(c) - patch + 1) / F.lit(step)), F.lit(0)).cast("long"), F.expr(f"{c} div {step}"))
    tiles = px.select("r", "c", "re", "im", F.explode(firsts("r")).alias("pr")).select("*", F.explode(firsts("c")).alias("pc"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(g["pr"].iloc[0]) * step, int(g["pc"].iloc[0]) * step
        r, c = g["r"].to_numpy() - r0, g["c"].to_numpy() - c0
        z = np.zeros((patch, patch), complex)
        z[r, c] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
        h, w = r.max() + 1, c.max() + 1
        if not np.any(z):
            return pd.DataFrame({"r": [], "c": [], "wre": [], "wim": [], "w": []})
        f = np.fft.fft2(z)
        s = _box3(np.abs(f))
        out = np.fft.ifft2(f * np.where(s > 0, s, 0.0) ** alpha if alpha else f)
        win = np.outer(_hann(patch), _hann(patch))
        ii, jj = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
        k = win[ii, jj].ravel()
        z = out[ii, jj].ravel()
        return pd.DataFrame({"r": ii.ravel() + r0, "c": jj.ravel() + c0, "wre": z.real * k, "wim": z.imag * k, "w": k})

    parts = tiles.groupBy("pr", "pc").applyInPandas(run, "r long, c long, wre double, wim double, w double")
    sums = parts.groupBy("r", "c").agg(F.sum("wre").alias("wre"), F.sum("wim").alias("wim"), F.sum("w").alias("w"))
    joined = px.select("r", "c").join(sums, ["r", "c"], "left")
    over = lambda v: F.when(F.col("w") > 0, F.col(v) / F.col("w")).otherwise(0.0)
    return joined.select("r", "c", over("wre").alias("re"), over("wim").alias("im"))


def chi2_1(confidence: float) -> float:
    """The quantile of the chi-square distribution with one degree of freedom."""
    return NormalDist().inv_cdf((1 + confidence) / 2) ** 2


def coherence_matrix(z: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Complex coherence of (..., images, pixels), over the pixels that ``keep`` (..., pixels) marks; 0 where an image has no power."""
    kept = z if keep is None else np.where(keep[..., None, :], z, 0)
    norm = np.sqrt((np.abs(kept) ** 2).sum(-1))
    under = norm[..., :, None] * norm[..., None, :]
    top = kept @ np.swapaxes(kept.conj(), -1, -2)
    return np.divide(top, under, out=np.zeros_like(top), where=under > 0)


def emi_phases(coh: np.ndarray) -> np.ndarray:
    """Phases from the eigenvector of inv(|C|) * C of least magnitude; matrices may be stacked.

    They are relative to the first image with power; one without has phase 0 and does not count.
    """
    n = coh.shape[-1]
    base = np.abs(coh) + 1e-6 * np.eye(n)
    w = np.linalg.inv(base) * coh
    w = (w + np.swapaxes(w.conj(), -1, -2)) / 2
    dead = np.abs(np.diagonal(coh, axis1=-2, axis2=-1)) == 0
    far = 1 + np.linalg.norm(w, axis=(-2, -1))[..., None]  # beyond all other values, so never the least
    w = w + np.where(dead, far, 0)[..., None] * np.eye(n)
    values, vectors = np.linalg.eigh(w)
    at = np.argmin(np.abs(values), axis=-1)[..., None, None]
    v = np.take_along_axis(vectors, at, axis=-1)[..., 0]
    first = np.take_along_axis(v, np.argmin(dead, axis=-1)[..., None], axis=-1)
    return np.where(dead, 0.0, np.angle(v * np.conj(first)))


def emi(stack: DataFrame) -> DataFrame:
    """(t, phase) of one set of pixels: an aggregate to the small coherence matrix, then one eigenvector."""
    elements = coherence_elements(stack)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g["i"].max()) + 1
        c = np.zeros((n, n), complex)
        c[g["i"], g["j"]] = g["re"] + 1j * g["im"]
        return pd.DataFrame({"t": np.arange(n), "phase": emi_phases(c)})

    return elements.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "t long, phase double")


def coherence_elements(stack: DataFrame) -> DataFrame:
    """(i, j, re, im) of the coherence matrix over all pixels: images are gathered per pixel, so only n*n sums cross partitions."""
    line = stack.groupBy("r", "c").agg(F.array_sort(F.collect_list(F.struct("t", "re", "im"))).alias("z"))
    pairs = line.select(F.explode("z").alias("x"), "z").select("x", F.explode("z").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = pairs.groupBy(x["t"].alias("i"), y["t"].alias("j")).agg(
        F.sum(x["re"] * y["re"] + x["im"] * y["im"]).alias("re"), F.sum(x["im"] * y["re"] - x["re"] * y["im"]).alias("im"),
        F.sum(x["re"] * x["re"] + x["im"] * x["im"]).alias("p"), F.sum(y["re"] * y["re"] + y["im"] * y["im"]).alias("q"),
    )
    under = F.sqrt(F.col("p") * F.col("q"))
    return sums.select("i", "j", *[F.when(under > 0, F.col(v) / under).otherwise(0.0).alias(v) for v in ("re", "im")])


#: Samples of all windows that one step of the linking holds (16 bytes each, some copies).
LINK_SAMPLES = 1 << 21


def _grown(near: np.ndarray) -> np.ndarray:
    """Of each window (windows, rows, columns) the marked pixels that touch its middle, over corners too, through marked ones."""
    h, w = near.shape[1] // 2, near.shape[2] // 2
    found = np.zeros_like(near)
    found[:, h, w] = near[:, h, w]
    going = np.arange(len(near))
    while len(going):
        wide = found[going]
        for axis in (1, 2):  # a step to each side along one axis, then along the other
            new = wide.copy()
            lo, hi = [slice(None)] * 3, [slice(None)] * 3
            lo[axis], hi[axis] = slice(None, -1), slice(1, None)
            new[tuple(hi)] |= wide[tuple(lo)]
            new[tuple(lo)] |= wide[tuple(hi)]
            wide = new
        wide &= near[going]
        more = (wide != found[going]).any((1, 2))
        found[going] = wide
        going = going[more]
    return found


def link_tile(z: np.ndarray, r0: int, r1: int, c0: int, c1: int, half: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Phases (t, h, w), amplitude, coherence of the pixels [r0, r1) x [c0, c1) of a tile with halo; windows go by the hundred."""
    n, side = len(z), 2 * half + 1
    view = np.lib.stride_tricks.sliding_window_view
    edge = [(half, half), (half, half)]
    padded = np.pad(z, [(0, 0), *edge])[:, r0 : r1 + 2 * half, c0 : c1 + 2 * half]
    var = (np.abs(padded) ** 2).sum(0) / (2 * n)
    samples, power = view(padded, (side, side), axis=(1, 2)), view(var, (side, side))
    shape = (r1 - r0, c1 - c0)
    own = z[:, r0:r1, c0:c1].reshape(n, -1)
    phase, amp, coh = np.angle(own), np.abs(own), np.zeros(own.shape)
    step = max(1, LINK_SAMPLES // (n * side * side))
    for at in range(0, own.shape[1], step):
        i, j = np.divmod(np.arange(at, min(at + step, own.shape[1])), shape[1])
        p = power[i, j]
        mine = p[:, half, half][:, None, None]
        with np.errstate(all="ignore"):
            test = 2 * np.log((p + mine) / 2) - np.log(p) - np.log(mine)
        near = _grown((p > 0) & (mine > 0) & (np.nan_to_num(test, nan=np.inf) < threshold)).reshape(len(i), -1)
        some = near.sum(1) >= 2
        if not some.any():
            continue
        near = near[some]
        found = samples[:, i[some], j[some]].transpose(1, 0, 2, 3).reshape(len(near), n, -1)
        c = coherence_matrix(found, near)
        where = at + np.flatnonzero(some)
        phase[:, where], coh[:, where] = emi_phases(c).T, np.abs(c[:, 0]).T
        amp[:, where] = (np.where(near[:, None], np.abs(found), 0).sum(2) / near.sum(1)[:, None]).T
    return tuple(x.reshape(n, *shape) for x in (phase, amp, coh))


def phase_link(stack: DataFrame, half: int = 11, confidence: float = 0.95, tile: int = 32) -> DataFrame:
    """(t, r, c, re, im, coh): linked phases of each sample's pixel from tiles with a halo of ``half`` pixels.

    Border pixels are copied to the tiles whose halo holds them; a tile is one group, so a scene of
    any size runs in parallel. A pixel without homogeneous neighbours keeps its sample, coherence 0.
    Times are kept as they are; a tile that lacks an acquisition is linked from those that it has,
    and samples that are not there get no row.
    """
    spread = lambda c: F.sequence(F.expr(f"greatest({c} - {half}, 0L) div {tile}"), F.expr(f"({c} + {half}) div {tile}"))
    copied = stack.select("t", "r", "c", "re", "im", F.explode(spread("r")).alias("ty")).select("*", F.explode(spread("c")).alias("tx"))
    kind = stack.schema["t"].dataType.simpleString()
    names = ("t", "r", "c", "re", "im", "coh")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(g["ty"].iloc[0]), int(g["tx"].iloc[0])
        ra, ca = int(g["r"].min()), int(g["c"].min())
        times, t = np.unique(g["t"].to_numpy(), return_inverse=True)
        shape = (len(times), int(g["r"].max()) - ra + 1, int(g["c"].max()) - ca + 1)
        z, there = np.zeros(shape, complex), np.zeros(shape, bool)
        at = (t, g["r"].to_numpy() - ra, g["c"].to_numpy() - ca)
        z[at], there[at] = g["re"] + 1j * g["im"], True
        r0, c0 = max(ty * tile - ra, 0), max(tx * tile - ca, 0)
        r1, c1 = min((ty + 1) * tile - ra, shape[1]), min((tx + 1) * tile - ca, shape[2])
        if r0 >= r1 or c0 >= c1:
            return pd.DataFrame({k: [] for k in names})
        phase, amp, coh = link_tile(np.nan_to_num(z), r0, r1, c0, c1, half, chi2_1(confidence) / (2 * len(times)))
        k, i, j = np.nonzero(there[:, r0:r1, c0:c1])
        linked = (amp * np.exp(1j * phase))[k, i, j]
        return pd.DataFrame({"t": times[k], "r": i + r0 + ra, "c": j + c0 + ca, "re": linked.real, "im": linked.imag, "coh": coh[k, i, j]})

    return copied.groupBy("ty", "tx").applyInPandas(run, f"t {kind}, r long, c long, re double, im double, coh double")


def labels(mask: np.ndarray) -> np.ndarray:
    """4-connected components, numbered from 1 in scan order; 0 outside."""
    out, k = np.zeros(mask.shape, np.int64), 0
    for i, j in zip(*np.nonzero(mask)):
        if out[i, j]:
            continue
        k += 1
        stack = [(i, j)]
        out[i, j] = k
        while stack:
            a, b = stack.pop()
            for x, y in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= x < mask.shape[0] and 0 <= y < mask.shape[1] and mask[x, y] and not out[x, y]:
                    out[x, y] = k
                    stack.append((x, y))
    return out


def _numbered(roots: DataFrame) -> DataFrame:
    """(root, number): distinct roots counted from 1 in their order; only counts of sorted partitions meet in one task."""
    placed = Written(roots.orderBy("root").select("root", F.monotonically_increasing_id().alias("at"))).df
    placed = placed.select("root", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("k"))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("of"), (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(before, F.col("part") == F.col("of")).select("root", (F.col("before") + F.col("k") + 1).alias("number"))


def connected(px: DataFrame, tile: int = 256) -> DataFrame:
    """(r, c, conncomp) of (r, c, ok): 4-connected components of good pixels from 1 in scan order, else 0.

    Tiles are labelled alone; a label is the first pixel of its component. Neighbours across a tile's
    edge link labels, and the links' components come from stars, so neither pixels nor labels meet in one group.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r, c, ok = g["r"].to_numpy(), g["c"].to_numpy(), g["ok"].to_numpy()
        r0, c0 = r.min(), c.min()
        mask = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), bool)
        mask[r - r0, c - c0] = ok
        found = labels(mask)
        names, at = np.unique(found, return_index=True)
        first = np.zeros(names[-1] + 1, np.int64)
        first[names] = ((r0 + at // mask.shape[1]) << 32) + c0 + at % mask.shape[1]
        # other pixels get a seed each that nothing meets, so they are no hot key
        return pd.DataFrame({"r": r, "c": c, "seed": np.where(ok, first[found[r - r0, c - c0]], -1 - (r << 32) - c)})

    by = px.select(F.col("r").cast("long"), F.col("c").cast("long"), F.coalesce("ok", F.lit(False)).alias("ok"))
    labelled = Written(by.withColumn("ty", F.expr(f"r div {tile}")).withColumn("tx", F.expr(f"c div {tile}")).groupBy("ty", "tx").applyInPandas(run, "r long, c long, seed long")).df
    here = F.shiftleft("r", 32) + F.col("c")
    row, col = F.pmod("r", F.lit(tile)), F.pmod("c", F.lit(tile))
    keys = F.array(
        F.when(row == tile - 1, F.struct(F.lit(1).alias("side"), here.alias("at"))).when(row == 0, F.struct(F.lit(1).alias("side"), (here - (1 << 32)).alias("at"))),
        F.when(col == tile - 1, F.struct(F.lit(2).alias("side"), here.alias("at"))).when(col == 0, F.struct(F.lit(2).alias("side"), (here - 1).alias("at"))),
    )
    good = labelled.where("seed >= 0")
    met = good.select("seed", F.explode(F.array_compact(keys)).alias("key"))
    links = met.groupBy("key").agg(F.min("seed").alias("u"), F.max("seed").alias("v")).where("u < v").select("u", "v")
    joined = Written(components(links)).df
    seeds = good.where(F.col("seed") == here).select("seed")
    rooted = Written(seeds.join(joined, F.col("seed") == F.col("node"), "left").select("seed", F.coalesce("root", "seed").alias("root"))).df
    numbers = Written(rooted.join(_numbered(rooted.select("root").distinct()), "root").select("seed", "number")).df
    return labelled.join(numbers, "seed", "left").select("r", "c", F.coalesce("number", F.lit(0).cast("long")).alias("conncomp"))


def unwrap(igram: DataFrame, min_coherence: float = 0.0, tile: int = 256) -> DataFrame:
    """(r, c, unw, conncomp) of (r, c, re, im, coh): path-following unwrapping without an external solver.

    Lines are unwrapped along their first pixels, then each along itself, past missing pixels and
    those that are NaN, which stay NaN. The result is congruent with the input and exact on ramps;
    components are where coherence is at least the limit. Whole turns are running sums: one window a
    line, and one over a row a line.
    """
    angle = F.atan2("im", "re")
    px = igram.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.when(~F.isnan("re") & ~F.isnan("im"), angle).alias("ph"), "coh")

    def summed(df: DataFrame, order: Window, name: str) -> DataFrame:
        before = F.last("ph", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))  # null is no angle; NaN would be above all
        step = F.col("ph") - before
        turn = F.when(step > np.pi, -1).when(step < -np.pi, 1).otherwise(0)
        return df.withColumn("turn", turn).withColumn(name, F.sum("turn").over(order)).drop("turn")

    along, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy(F.lit(0)).orderBy("r")
    first = F.min_by("ph", F.when(F.col("ph").isNotNull(), F.col("c"))).alias("ph")
    heads = summed(px.groupBy("r").agg(first), down, "before").select("r", "before")
    whole = F.coalesce(F.col("ph") + (F.col("before") + F.col("within")) * F.lit(2 * np.pi), F.lit(float("nan")))
    phase = summed(px, along, "within").join(heads, "r").select("r", "c", whole.alias("unw"))
    good = connected(px.select("r", "c", ((F.col("coh") >= min_coherence) & ~F.isnan("coh")).alias("ok")), tile)
    return phase.join(good, ["r", "c"])


def multilook_coherence(a: DataFrame, b: DataFrame, ly: int, lx: int, ny: int, nx: int, antialias: str | None = None) -> DataFrame:
    """(lr, lc, re, im, coh) with the numerator from antialiased products (``range`` or ``2d``).

    The powers below are not filtered, so the value may exceed one; it is not clipped.
    """
    from .sar import interferogram, multilook, safe_div
    from .sar import multilook_coherence as plain

    if antialias in (None, "none"):
        return plain(a, b, ly, lx, ny, nx)
    top = multilook(antialiased(a, b, antialias == "2d"), ["re", "im"], ly, lx, ny, nx)
    powers = interferogram(a, b).select("r", "c", F.expr("re1*re1 + im1*im1").alias("p1"), F.expr("re2*re2 + im2*im2").alias("p2"))
    both = top.join(multilook(powers, ["p1", "p2"], ly, lx, ny, nx), ["lr", "lc"])
    return both.select("lr", "lc", "re", "im", safe_div(F.sqrt(F.expr("re*re + im*im")), F.sqrt(F.expr("p1*p2"))).alias("coh"))


def coherence_tiled(a: DataFrame, b: DataFrame, weights: list[float], ny: int, nx: int, tile: int = 256) -> DataFrame:
    """(r, c, coh), as the window form gives, in one shuffle of tiles with their halo; for large scenes.

    The join is by pixel, the halo is copied, and each tile is smoothed alone; a tile at the
    scene's edge reflects its own samples, so it must be at least as wide as half the window.
    """
    from .sar import interferogram

    h = len(weights) // 2
    if tile < h:
        raise ValueError("a tile must hold half a window")
    w = np.array(weights)
    last_r, last_c = (ny - 1) // tile, (nx - 1) // tile
    spread = lambda c, last: F.sequence(F.expr(f"greatest({c} - {h}, 0L) div {tile}"), F.least(F.expr(f"({c} + {h}) div {tile}"), F.lit(last).cast("long")))
    x = interferogram(a, b).select("r", "c", "re", "im", F.expr("re1*re1 + im1*im1").alias("p1"), F.expr("re2*re2 + im2*im2").alias("p2"))
    copied = x.withColumn("ty", F.explode(spread("r", last_r))).withColumn("tx", F.explode(spread("c", last_c)))

    def smooth(z: np.ndarray, axis: int, lo: int, hi: int, n: int) -> np.ndarray:
        """Lines [lo, hi) of the scene along an axis, from a tile that starts h before lo where the scene does."""
        before, after = max(h - lo, 0), max(hi + h - n, 0)
        z = np.pad(z, [(before, after) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        return sum(v * np.take(z, range(k, k + hi - lo), axis) for k, v in enumerate(w))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(g["ty"].iloc[0]) * tile, int(g["tx"].iloc[0]) * tile
        r1, c1 = min(r0 + tile, ny), min(c0 + tile, nx)
        ra, ca = max(r0 - h, 0), max(c0 - h, 0)
        out = []
        for name in ("re", "im", "p1", "p2"):
            z = np.zeros((min(r1 + h, ny) - ra, min(c1 + h, nx) - ca))
            z[g["r"] - ra, g["c"] - ca] = g[name]
            out.append(smooth(smooth(z, 0, r0, r1, ny), 1, c0, c1, nx))
        re, im, p1, p2 = out
        under = np.sqrt(p1 * p2)
        coh = np.divide(np.hypot(re, im), under, out=np.zeros_like(under), where=under > 0)
        rr, cc = np.meshgrid(np.arange(r0, r1), np.arange(c0, c1), indexing="ij")
        return pd.DataFrame({"r": rr.ravel(), "c": cc.ravel(), "coh": np.clip(coh, 0, 1).ravel()})

    return copied.groupBy("ty", "tx").applyInPandas(run, "r long, c long, coh double")
