"""A product file as tables: its metadata is read on the driver, its rasters chunk by chunk by tasks."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sar, selection
from ..session import importable
from . import h5, products
from .catalog import POLARIZATIONS
from .geotiff import Grid

# fixed values: bands of each product; of interferograms with the layer and the variable that hold them
GSLC_BANDS = ("amplitude",)
GUNW_BANDS = {
    "unwrapped_phase": ("unwrappedInterferogram", "unwrappedPhase"),
    "wrapped_phase": ("wrappedInterferogram", "wrappedInterferogram"),
    "coherence": ("unwrappedInterferogram", "coherenceMagnitude"),
    "ionosphere": ("unwrappedInterferogram", "ionospherePhaseScreen"),
}

Box = tuple[float, float, float, float]


@dataclass
class Product:
    """An open product: its type, its attributes by group, and its arrays by path."""

    spark: SparkSession
    path: str
    kind: str
    attrs: dict[str, dict]
    arrays: dict[str, tuple]

    def identification(self) -> dict:
        return next((a for p, a in sorted(self.attrs.items()) if p.endswith("identification")), {})

    def group(self, frequency: str = "A", layer: str | None = None) -> str:
        """The path of a frequency's grids, or of a layer of them."""
        end = f"{self.kind}/grids/{products.frequency(frequency)}" + (f"/{layer}" if layer else "")
        found = sorted(p for p in self.attrs if p.endswith(end))
        if not found:
            raise ValueError(f"{self.path} has no {end}")
        return found[0]

    def frequencies(self) -> list[str]:
        return sorted({p.rpartition("/")[2] for p in self.attrs if p.rpartition("/")[0].endswith(f"{self.kind}/grids")})

    def polarizations(self, frequency: str = "A") -> list[str]:
        """Those that there are: images of a GSLC, groups of a GUNW's unwrapped layer."""
        if self.kind == "GSLC":
            at, names = self.group(frequency), self.arrays
        else:
            at, names = self.group(frequency, "unwrappedInterferogram"), self.attrs
        return [p for p in POLARIZATIONS if f"{at}/{p}" in names]

    def grid(self, group: str) -> Grid:
        """The regular grid of a group: its own coordinates and projection, or those of the nearest group above."""
        with h5.need("h5py").File(self.path) as f:

            def nearest(name: str):
                at = group
                while at:
                    if f"{at}/{name}" in f:
                        return f[f"{at}/{name}"]
                    at = at.rpartition("/")[0]
                return None

            axes = []
            for name in ("yCoordinates", "xCoordinates"):
                axis = nearest(name)
                if axis is None or axis.shape[0] < 2:
                    raise ValueError(f"{group} has no regular {name}")
                first, second = (float(v) for v in axis[0:2])
                axes.append((first, second - first, int(axis.shape[0])))
            projection = nearest("projection")
            epsg = h5.epsg_of(projection) if projection is not None else None
        if epsg is None:
            raise ValueError(f"{group} has no projection")
        return Grid(axes[0], axes[1], epsg)

    def window(self, grid: Grid, box: Box | None) -> tuple[int, int, int, int]:
        """(r0, r1, c0, c1), ends excluded, of a box in the grid's own coordinates; an error if it meets no sample."""
        if box is None:
            return 0, grid.shape[0], 0, grid.shape[1]
        (r0, r1), (c0, c1) = selection.index_range(grid.y, box[1], box[3]), selection.index_range(grid.x, box[0], box[2])
        if r1 < r0 or c1 < c0:
            ends = [sorted((a, a + s * (n - 1))) for a, s, n in (grid.x, grid.y)]
            raise ValueError(f"the box {box} does not meet x {ends[0]}, y {ends[1]}")
        return r0, r1 + 1, c0, c1 + 1

    def raster(self, dataset: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
        """(product_id, r, c, re, im) of a dataset; only chunks that meet the window are read."""
        if dataset not in self.arrays:
            raise ValueError(f"{self.path} has no {dataset}")
        reader = self.spark.read.format("sar_h5").option("dataset", dataset)
        if window:
            reader = reader.option("window", ",".join(map(str, window)))
        return reader.load(self.path)

    def slc(self, polarization: str = "HH", frequency: str = "A", box: Box | None = None, masked: bool = True) -> tuple[DataFrame, Grid, tuple[int, int]]:
        """((r, c, re, im), grid, first row and column) of a GSLC's image in a box; NaN outside the subswaths if it has a mask."""
        if self.kind != "GSLC":
            raise ValueError(f"a GSLC is needed, not {self.kind}")
        at, polarization = self.group(frequency), products.polarization(self.polarizations(frequency), polarization)
        grid = self.grid(at)
        w = self.window(grid, box)
        name = F.lit(products.frequency(frequency)).alias("frequency")
        images = self.raster(f"{at}/{polarization}", w).select(name, F.lit(polarization).alias("polarization"), "r", "c", "re", "im")
        masks = self.raster(f"{at}/mask", w).select(name, "r", "c", F.col("re").cast("int").alias("mask")) if masked and f"{at}/mask" in self.arrays else None
        return selection.get_slc(images, polarization, frequency, masks), grid.part(*w), (w[0], w[2])

    def band(self, band: str, polarization: str | None = None, frequency: str = "A", box: Box | None = None) -> tuple[DataFrame, Grid, tuple[int, int]]:
        """((r, c, band), grid, first row and column) of a band by name."""
        if band not in self.bands():
            raise ValueError(f"{band} is no band of a {self.kind}; bands: {', '.join(self.bands())}")
        polarization = products.polarization(self.polarizations(frequency), polarization)
        if self.kind == "GSLC":
            px, grid, origin = self.slc(polarization, frequency, box)
            return px.select("r", "c", sar.to_db(F.sqrt(F.expr("re*re + im*im")), power=False).alias(band)), grid, origin
        layer, variable = GUNW_BANDS[band]
        at = f"{self.group(frequency, layer)}/{polarization}"
        grid = self.grid(at)
        w = self.window(grid, box)
        value = sar.phase(F.col("re"), F.col("im")) if band == "wrapped_phase" else F.col("re")
        return self.raster(f"{at}/{variable}", w).select("r", "c", value.alias(band)), grid.part(*w), (w[0], w[2])

    def bands(self) -> list[str]:
        return list(GSLC_BANDS if self.kind == "GSLC" else GUNW_BANDS)

    def summary(self) -> dict:
        """Type, identification, and the grids and polarizations of each frequency; of a GUNW also the days between its acquisitions and coherence."""
        own = self.identification()
        found = {"file": Path(self.path).name, "product_type": self.kind, **{k: str(v) for k, v in sorted(own.items()) if k != "productType"}}
        starts = [own.get(f"{w}ZeroDopplerStartTime") for w in ("reference", "secondary")]
        if all(starts):
            a, b = (products.parse_date(str(s)[:26]) for s in starts)
            found["temporal_baseline_days"] = (b - a).days
        found["frequencies"] = {}
        for name in self.frequencies():
            pols = self.polarizations(name)
            at = self.group(name) if self.kind == "GSLC" else self.group(name, "unwrappedInterferogram") + f"/{pols[0]}"
            grid = self.grid(at)
            ends = {k: sorted((a, a + s * (n - 1))) for k, (a, s, n) in (("x", grid.x), ("y", grid.y))}
            found["frequencies"][name] = {"polarizations": pols, "epsg": grid.epsg, "shape": list(grid.shape), "resolution": [abs(grid.x[1]), abs(grid.y[1])], "extent": ends}
            if self.kind == "GUNW":
                stats = {p: selection.array_stats(self.band("coherence", p, name)[0], "coherence").first().asDict() for p in pols}
                found["frequencies"][name]["coherence"] = stats
        return found


def open_product(spark: SparkSession, path: str) -> Product:
    """The product in a file; an error if there is no such file, or it holds no product that can be read."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    if not h5.valid(path):
        raise ValueError(f"{path} holds no product")
    h5.register(importable(spark))
    nodes, variables = h5.walk(path)
    attrs = {n[1]: n[2] for n in nodes}
    own = next(a for p, a in sorted(attrs.items()) if p.endswith("identification"))
    return Product(spark, path, products.product_type(own["productType"]), attrs, {f"{v[1]}/{v[2]}": v for v in variables})
