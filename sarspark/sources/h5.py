"""A lazy HDF5 source: one input partition for each chunk of a dataset of one to three dimensions. Needs h5py where it runs."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .products import COORDINATES, SKIPPED_ATTRS, chunks, decode, dimensions

#: Index columns by the number of dimensions: an axis, a raster, a cube of rasters.
INDICES = {1: ("i",), 2: ("r", "c"), 3: ("k", "r", "c")}
#: A dataset that is read in one piece and is larger than this draws a warning.
LARGE = 100 << 20


def need(module: str):
    """The module, or an error that says what it is needed for."""
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"{module} is not installed; it is needed for this file format. Parquet pixel tables need nothing more.") from e


class Chunk(InputPartition):
    def __init__(self, path: str, starts: tuple[int, ...], stops: tuple[int, ...]):
        self.path, self.starts, self.stops = path, starts, stops


class Reader(DataSourceReader):
    """``window`` is r0,r1,c0,c1 of rasters and of every layer of cubes; ``chunks`` is auto, none, or a number for every dimension."""

    def __init__(self, options: dict):
        self.paths, self.dataset = options["path"].split(","), options["dataset"]
        self.box = [int(x) for x in options["window"].split(",")] if options.get("window") else None
        self.wanted = options.get("chunks", "auto")

    def _pieces(self, d) -> tuple[int, ...]:
        if self.wanted in ("auto", ""):
            return chunks(d.shape, d.chunks)
        if self.wanted == "none":
            size = int(np.prod(d.shape)) * getattr(getattr(d, "dtype", None), "itemsize", 16)
            if size > LARGE:
                warnings.warn(f"{self.dataset} has {size >> 20} MB and is read by one task", stacklevel=2)
            return tuple(d.shape)
        return tuple(int(x) for x in self.wanted.split(","))

    def partitions(self) -> list[Chunk]:
        h5py, out = need("h5py"), []
        for path in self.paths:
            with h5py.File(path) as f:
                d = f[self.dataset]
                shape, piece = tuple(d.shape), self._pieces(d)
            ends = [(0, n) for n in shape]
            if self.box and len(shape) > 1:
                ends[-2:] = [(max(a, 0), min(b, n)) for a, b, n in zip(self.box[::2], self.box[1::2], shape[-2:])]
            sides = [[(max(s, a), min(s + p, b)) for s in range(a // p * p, b, p)] for (a, b), p in zip(ends, piece)]
            out += [Chunk(path, *zip(*sides_of)) for sides_of in itertools.product(*sides)]
        return out

    def read(self, part: Chunk) -> Iterator[pa.RecordBatch]:
        with need("h5py").File(part.path) as f:
            z = np.asarray(f[self.dataset][tuple(slice(a, b) for a, b in zip(part.starts, part.stops))])
        at = np.meshgrid(*[np.arange(a, b) for a, b in zip(part.starts, part.stops)], indexing="ij")
        flat = z.ravel()
        values = {"v": flat.astype(float)} if z.ndim == 1 else {"re": flat.real.astype(float), "im": flat.imag.astype(float)}
        columns = {"product_id": pa.array([part.path] * flat.size), **{n: pa.array(x.ravel()) for n, x in zip(INDICES[z.ndim], at)}, **{n: pa.array(x) for n, x in values.items()}}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class H5Source(DataSource):
    """``spark.read.format("sar_h5").option("dataset", ...).load(path)``.

    Axes are (product_id, i, v), rasters (product_id, r, c, re, im), cubes (product_id, k, r, c, re, im).
    """

    @classmethod
    def name(cls) -> str:
        return "sar_h5"

    def schema(self) -> str:
        with need("h5py").File(self.options["path"].split(",")[0]) as f:
            n = len(f[self.options["dataset"]].shape)
        if n not in INDICES:
            raise ValueError(f"{self.options['dataset']} has {n} dimensions; one to three can be read")
        return "product_id string, " + ", ".join(f"{i} long" for i in INDICES[n]) + (", v double" if n == 1 else ", re double, im double")

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(H5Source)


def _scales(f, item) -> list[str | None] | None:
    """The names of the dimension scales that a dataset refers to, or None where it has no list of them."""
    held = item.attrs.get("DIMENSION_LIST")
    if held is None:
        return None
    return [f[refs[0]].name.rpartition("/")[2] if len(refs) else None for refs in held]


def epsg_of(projection) -> int | None:
    """The code of a projection variable: its attribute, else its value as number or text."""
    value = decode(projection.attrs.get("epsg_code", projection[()]))
    try:
        return int(str(value).strip())
    except ValueError:
        return None


def walk(path: str) -> tuple[list[tuple], list[tuple]]:
    """The (nodes, variables) of one file, for products.tree; only metadata is read.

    Of a group, scalars and lists that are no coordinates become attributes; coordinates and larger
    arrays become variables with named dimensions. A projection adds ``epsg`` where both x and y are there.
    """
    h5py, nodes, variables = need("h5py"), [], []

    def group(name: str, g) -> None:
        sets = {k: v for k, v in g.items() if isinstance(v, h5py.Dataset)}
        attrs = {k: v for k, v in dict(g.attrs).items() if k not in SKIPPED_ATTRS}
        lengths = {COORDINATES[k]: int(v.shape[0]) for k, v in sets.items() if v.ndim == 1 and k in COORDINATES}
        for k, v in sets.items():
            if v.ndim == 0 or v.ndim == 1 and k not in COORDINATES:
                attrs[k] = decode(v[()])
        if "projection" in sets and {"x", "y"} <= set(lengths) and epsg_of(sets["projection"]):
            attrs["epsg"] = epsg_of(sets["projection"])
        nodes.append((path, name, attrs))
        for k, v in sets.items():
            if v.ndim > 1 or v.ndim == 1 and k in COORDINATES:
                dims = (COORDINATES[k],) if v.ndim == 1 else dimensions(v.shape, lengths, k, _scales(f, v))
                own = {a: str(decode(x)) for a, x in dict(v.attrs).items() if a not in SKIPPED_ATTRS}
                variables.append((path, name, k, list(dims), list(v.shape), str(v.dtype), list(v.chunks or v.shape), own))

    with h5py.File(path) as f:
        group("", f)
        f.visititems(lambda name, item: group(name, item) if isinstance(item, h5py.Group) else None)
    return nodes, variables


def valid(path: str, thorough: bool = False) -> bool:
    """Whether a file opens and has a radar band with a product type and grids or swaths; ``thorough`` also reads a sample of each dataset."""
    h5py = need("h5py")
    try:
        with h5py.File(path) as f:
            for band in ("LSAR", "SSAR"):
                top = f.get(f"science/{band}")
                if top is not None and "identification/productType" in top:
                    kind = top["identification/productType"][()].decode().strip()
                    good = kind in top and ("grids" in top[kind] or "swaths" in top[kind])
                    if good and thorough:
                        f.visititems(lambda _, item: item[(0,) * item.ndim] if isinstance(item, h5py.Dataset) and all(item.shape) else None)
                    return good
    except (OSError, RuntimeError):
        return False
    return False
