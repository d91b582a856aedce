"""Selection, corrections and product reading on tables and on a stand-in for the HDF5 library."""

import math
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarspark.operators import corrections, geometry, selection
from sarspark.sources import h5, products


@pytest.fixture
def images(spark):
    rows = [(f, p, r, c, float(r), float(c)) for f, pols in (("frequencyA", ("HH", "HV")), ("frequencyB", ("HH",))) for p in pols for r in range(4) for c in range(5)]
    return spark.createDataFrame(rows, "frequency string, polarization string, r long, c long, re double, im double")


def test_get_slc(spark, images):
    masks = spark.createDataFrame([("frequencyA", 0, 0, 1), ("frequencyA", 0, 1, 0), ("frequencyA", 0, 2, 255), ("frequencyA", 1, 1, 2)], "frequency string, r long, c long, mask int")
    got = {(x.r, x.c): x.re for x in selection.get_slc(images, "HV", masks=masks).collect()}
    assert len(got) == 20 and {k for k, v in got.items() if not math.isnan(v)} == {(0, 0), (1, 1)}
    assert selection.get_slc(images, "HH", "B").count() == 20 and selection.get_mask(masks).count() == 4
    for bad, said in ((lambda: selection.get_slc(images, "VV"), "HH, HV"), (lambda: selection.get_slc(images, "HV", "B"), "available: HH"), (lambda: selection.get_slc(images, product_type="GUNW"), "GUNW"), (lambda: selection.get_mask(masks, "B"), "frequencyA")):
        with pytest.raises(ValueError, match=said):
            bad()


def test_get_gunw(spark):
    layer = "unwrappedInterferogram"
    bands = spark.createDataFrame([("frequencyA", layer, "HH", 0, c, c) for c in range(6)], "frequency string, layer string, polarization string, r long, c long, labels int")
    masks = spark.createDataFrame([("frequencyA", layer, 0, c, m) for c, m in enumerate((11, 10, 1, 255, 111))], "frequency string, layer string, r long, c long, mask int")
    got = [x.labels for x in selection.get_gunw(bands, "labels", masks=masks).orderBy("c").collect()]
    assert [math.isnan(x) for x in got] == [False, True, True, True, False, True] and got[4] == 4.0
    for bad in (dict(value="none"), dict(value="labels", layer="other"), dict(value="labels", layer="pixelOffsets"), dict(value="labels", product_type="GSLC")):
        with pytest.raises(ValueError):
            selection.get_gunw(bands, **bad)


def test_boxes_become_index_ranges(spark):
    down, up, x = (100.0, -10.0, 11), (0.0, 10.0, 11), (0.0, 5.0, 21)
    assert selection.index_range(down, 20, 55) == (5, 8) and selection.index_range(up, 20, 55) == (2, 5) and selection.index_range(x, 101, 300) == (0, -1)
    px = spark.range(11 * 21).select(F.expr("id div 21").alias("r"), (F.col("id") % 21).alias("c"))
    got = {(p.r, p.c) for p in selection.crop_bbox(px, down, x, (10, 20, 20, 55)).collect()}
    assert got == {(r, c) for r in range(5, 9) for c in range(2, 5)}
    with pytest.raises(ValueError, match="does not meet"):
        selection.crop_bbox(px, down, x, (200, 0, 300, 10))


def raster(spark, x0, y0):
    return spark.range(12).select(F.expr("id div 4").alias("r"), (F.col("id") % 4).alias("c")).select("r", "c", (x0 + F.col("c") * 1.0).alias("x"), (y0 - F.col("r") * 1.0).alias("y"))


def test_overlap(spark):
    a, b = selection.crop_to_overlap(raster(spark, 0.0, 10.0), raster(spark, 2.0, 9.0))
    assert {(p.x, p.y) for p in a.collect()} == {(p.x, p.y) for p in b.collect()} == {(x, y) for x in (2.0, 3.0) for y in (8.0, 9.0)}
    with pytest.raises(ValueError, match="do not overlap"):
        selection.crop_to_overlap(raster(spark, 0.0, 10.0), raster(spark, 3.0, 50.0))


def test_cubes_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    dims = (3, 9, 11)
    cube = spark.createDataFrame([(k, j, i, float(rng.normal())) for k, j, i in np.ndindex(*dims)], "k int, j int, i int, v double")
    at = [tuple(float(x) for x in rng.uniform(-0.2, n - 0.8, 1)) for _ in range(60) for n in dims]
    points = [(n, *(p[0] for p in at[3 * n : 3 * n + 3])) for n in range(60)] + [(60, 2.0, 8.0, 10.0), (61, 0.0, 0.0, 0.0), (62, 1.0, 4.0, 8.0), (63, 2.0, 8.0, 10.01)]
    px = spark.createDataFrame(points, "n int, a double, b double, d double")
    want = None
    for block in (64, 4, 3, 1):
        got = {p.n: p.v for p in geometry.interpolate_cube(px, cube, "v", F.col("a"), F.col("b"), F.col("d"), dims, block).collect()}
        want = want or got
        assert got.keys() == want.keys() and all((math.isnan(got[n]) and math.isnan(want[n])) or abs(got[n] - want[n]) < 1e-12 for n in got)
    assert not math.isnan(want[60]) and not math.isnan(want[61]) and math.isnan(want[63])


def test_corrections_check_shapes_and_finish(spark):
    dem = raster(spark, 0.0, 10.0).withColumn("elev", F.lit(5.0))
    cube = spark.createDataFrame([(k, j, i, 1.0 + k) for k in range(2) for j in range(2) for i in range(2)], "k int, j int, i int, v double")
    axes = corrections.Axes((0.0, 10.0, 2), (8.0, 2.0, 2), (3.0, -3.0, 2))
    phase = dem.select("r", "c", F.lit(7.0).alias("unw"))
    out = corrections.finalized(corrections.correct_atmosphere(phase, dem, cube, cube, axes, phase.withColumnRenamed("unw", "iono")), "unw", "troposphere, ionosphere")
    assert {(x.unw, x.applied) for x in out.collect()} == {(-3.0, "troposphere, ionosphere")} and out.schema["unw"].dataType.simpleString() == "float"
    with pytest.raises(ValueError, match="elevation model"):
        corrections.correct_troposphere(phase.where("r < 2"), dem, cube, cube, axes)


def test_baseline_of_a_sine_orbit_needs_each_orbits_own_time(spark):
    """Orbits that no cubic fits: the spline of 20 vectors is close, and the same orbit at two times lies apart by its way."""
    t = np.arange(20) * 10.0
    radius, w = 7.0e6, 1.05e-3
    rows = [(float(x), radius * math.cos(w * x), radius * math.sin(w * x), 0.0, -radius * w * math.sin(w * x), radius * w * math.cos(w * x), 0.0) for x in t]
    orbit = spark.createDataFrame(rows, "t double, px double, py double, pz double, vx double, vy double, vz double")
    grid = spark.createDataFrame([(k, 0, 0, 500000.0, 4000000.0, None if k == 1 else 1e5, 95.0, 95.0 + 0.01) for k in range(3)], "k int, j int, i int, x double, y double, h double, ref_time double, sec_time double")
    row = corrections.compute_baseline(grid, orbit, orbit, 32611).collect()
    assert len(row) == 1
    same = corrections.compute_baseline(grid.withColumn("sec_time", F.col("ref_time")), orbit, orbit, 32611).first()
    assert abs(same.b_perp) < 1e-6 and abs(same.b_par) < 1e-6
    way = radius * w * 0.01  # along the track: across it almost nothing is left
    assert abs(row[0].b_perp) < way and abs(row[0].b_par) <= way * 1.001 and (row[0].b_perp, row[0].b_par) != (same.b_perp, same.b_par)


class Dataset:
    def __init__(self, value, chunks=None, attrs=None, name=""):
        self.value, self.chunks, self.attrs, self.name = np.asarray(value), chunks, attrs or {}, name
        self.shape, self.ndim, self.dtype = self.value.shape, self.value.ndim, self.value.dtype

    def __getitem__(self, key):
        return self.value[key]


class Group(dict):
    def __init__(self, items=(), attrs=None):
        super().__init__(items)
        self.attrs = attrs or {}


def test_trees_and_cubes_of_a_file(spark, monkeypatch):
    x, y, z = Dataset(np.arange(4) * 100.0, name="/g/xCoordinates"), Dataset(np.arange(4) * 10.0, name="/g/yCoordinates"), Dataset(np.arange(2) * 500.0, name="/g/heightAboveEllipsoid")
    refs = {"x": x, "y": y, "z": z}
    grid = Group(
        {
            "xCoordinates": x, "yCoordinates": y, "heightAboveEllipsoid": z, "projection": Dataset(b" 32611 "), "listOfPolarizations": Dataset([b"HH", b"HV"]), "centerFrequency": Dataset(1.257e9),
            "cube": Dataset(np.arange(32.0).reshape(2, 4, 4), (1, 3, 4), {"DIMENSION_LIST": [["z"], ["y"], ["x"]], "units": b"rad"}), "square": Dataset(np.zeros((4, 4)), None), "odd": Dataset(np.zeros((4, 7)), None),
        },
        {"CLASS": b"no", "kind": b"grid"},
    )

    class File(Group):
        def __init__(self, path):
            super().__init__({"g": grid, "g/cube": grid["cube"], "g/xCoordinates": x})

        def __getitem__(self, key):
            return refs[key] if key in refs else super().__getitem__(key)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

        def items(self):
            return []

        def visititems(self, f):
            f("g", grid)

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File, Group=Group, Dataset=Dataset))
    nodes, variables = h5.walk("p")
    attrs = next(a for _, name, a in nodes if name == "g")
    assert attrs["listOfPolarizations"] == ["HH", "HV"] and attrs["centerFrequency"] == 1.257e9 and attrs["epsg"] == 32611 and "CLASS" not in attrs
    found = {v[2]: v for v in variables}
    assert found["cube"][3] == ["z", "y", "x"] and found["cube"][7] == {"units": "rad"} and found["cube"][6] == [1, 3, 4]
    assert set(found["square"][3]) == {"x", "y"} and found["odd"][3][1] == "odd_dim_0" and found["xCoordinates"][3] == ["x"]
    tree = products.tree(spark, nodes, variables)
    assert products.first_grid(tree[1]).first().path == "g"
    assert h5.H5Source({"path": "p", "dataset": "g/cube"}).schema() == "product_id string, k long, r long, c long, re double, im double"
    assert h5.H5Source({"path": "p", "dataset": "g/xCoordinates"}).schema() == "product_id string, i long, v double"
    reader = h5.Reader({"path": "p", "dataset": "g/cube", "window": "1,4,0,2"})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) == 4 and {(r["k"], r["r"], r["c"]): r["re"] for r in rows} == {(k, r, c): float(16 * k + 4 * r + c) for k in range(2) for r in range(1, 4) for c in range(2)}
    axis = h5.Reader({"path": "p", "dataset": "g/xCoordinates", "chunks": "none"})
    assert [r["v"] for p in axis.partitions() for b in axis.read(p) for r in b.to_pylist()] == [0.0, 100.0, 200.0, 300.0]
    monkeypatch.setattr(h5, "LARGE", 8)
    with pytest.warns(UserWarning, match="one task"):
        h5.Reader({"path": "p", "dataset": "g/cube", "chunks": "none"}).partitions()


def test_boxes_by_all_key_sets():
    for keys in (("xmin", "ymin", "xmax", "ymax"), ("west", "south", "east", "north"), ("minx", "miny", "maxx", "maxy")):
        assert products.box_of(dict(zip(keys, (1, 2, 3, 4)))) == (1, 2, 3, 4)
    assert products.chunks((9, 8, 700), (4, 4, 4)) == (4, 4, 4) and products.chunks((9, 8), None, {"y": 3}, ("y", "x")) == (3, 8)
