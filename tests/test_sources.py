"""Sources, sinks, catalog choices, configuration, streaming and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from sarspark import cli
from sarspark.plans import runconfig
from sarspark.sources import catalog, h5, products, sinks
from sarspark.streaming import ingest


@pytest.fixture
def px(spark):
    rows = [(r, c, float(r), float(c)) for r in range(20) for c in range(30)]
    return spark.createDataFrame(rows, "r long, c long, re double, im double")


def test_tiles_prune_and_round_trip(spark, px, tmp_path):
    sinks.write_pixels(px, str(tmp_path / "t"), tile=8)
    got = sinks.read_pixels(spark, str(tmp_path / "t"), (3, 11, 7, 9), tile=8)
    assert {(r.r, r.c, r.re, r.im) for r in got.collect()} == {(r, c, float(r), float(c)) for r in range(3, 11) for c in (7, 8)}
    assert "PartitionFilters: [isnotnull(tile_r" in got._jdf.queryExecution().toString()
    assert sinks.merge_complex(sinks.split_complex(px, "v"), "v").columns == px.columns
    assert sinks.merge_complex(px.withColumnRenamed("re", "v_real"), "v").columns == ["r", "c", "v_real", "im"]


def test_render_and_missing_libraries(px):
    assert sinks.render_frame(px, "re", 20, 30, 10).shape == (6, 10)
    with pytest.raises(ImportError, match="no_such_module"):
        h5.need("no_such_module")


def test_filenames(spark):
    names = [
        "NISAR_L2_PR_GSLC_004_077_A_024_4005_DHDH_A_20251103T124615_20251103T124650_X05009_N_F_J_001.h5",
        "/data/NISAR_L2_PR_GUNW_006_149_D_024_009_4000_SH_20251202T123756_20251202T123831_20260107T123757_20260107T123832_X05010_N_F_J_001_QA_STATS.h5",
        "OTHER_1_2.h5", None,
    ]
    got = [r.f for r in spark.createDataFrame([(n,) for n in names], "n string").select(catalog.parse_filename(F.col("n")).alias("f")).collect()]
    assert (got[0].product, got[0].track, got[0].frame, got[0].is_ascending, got[0].is_qa) == ("GSLC", 77, 24, True, False)
    assert (got[1].product, got[1].direction, got[1].is_qa, str(got[1].start)) == ("GUNW", "Descending", True, "2025-12-02 12:37:56")
    assert got[2] is None and got[3] is None


def test_choices():
    assert products.frequency("A") == "frequencyA" and products.polarization(["mask", "HV"]) == "HV"
    assert products.product_type(b"GSLC ") == "GSLC"
    for bad in (lambda: products.frequency("a"), lambda: products.polarization(["HH"], "VV"), lambda: products.product_type("RSLC")):
        with pytest.raises(ValueError):
            bad()
    assert products.dimensions((3, 5), {"x": 5, "y": 3}) == ("y", "x")
    assert products.dimensions((4, 4, 7), {"x": 4, "y": 4}, "v") == ("x", "y", "v_dim_0")
    assert products.dimensions((2, 3), {}, "v", ["yCoordinates", None]) == ("y", "v_dim_0")
    assert products.chunks((1000, 10)) == (512, 10) and products.chunks((9, 9), (4, 4)) == (4, 4) and products.chunks((9,), None, None) is None
    assert products.chunks((9, 8), None, {"y": 3}, ("y", "x")) == (3, 8)


def test_dates_boxes_urls(tmp_path):
    a, b = products.date_range("2025-01-01T02:00:00+02:00", "2025-02-01")
    assert (a.hour, a.tzinfo, b.month) == (0, None, 2)
    for bad in (("2025-02-01", "2025-01-01"), ("2020-01-01", "2025-01-01")):
        with pytest.raises(ValueError):
            products.date_range(*bad)
    assert products.box_of([3, 4, 1, 2]) == (1, 2, 3, 4) and products.box_of((1, 2)) == (1, 2, 1, 2)
    assert products.box_of({"west": 1, "south": 2, "east": 3, "north": 4}) == (1, 2, 3, 4)
    assert products.box_of("POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))") == (0, 0, 2, 1)
    for bad in ((1, 2, 1, 4), {"west": 1}, "POLYGON EMPTY", (1, 2, 3)):
        with pytest.raises(ValueError):
            products.box_of(bad)
    assert products.checked_urls([" http://a/b "]) == ["http://a/b"]
    with pytest.raises(ValueError):
        products.checked_urls(["ftp://a"])
    assert products.checked_path(str(tmp_path / "new"), make=True).exists()
    with pytest.raises(FileNotFoundError):
        products.checked_path(str(tmp_path / "none"), must_exist=True)


def test_trees(spark):
    nodes = [("p", "science/LSAR/identification", {"productType": b"GSLC", "trackNumber": 77, "frameNumber": 24, "CLASS": b"x"}), ("p", "empty", {})]
    variables = [("p", f"g/{f}", n, [n], [3], "f8", [3], {}) for f in ("b", "a") for n in ("xCoordinates", "yCoordinates")]
    n, v = products.tree(spark, nodes, variables)
    assert n.count() == 1 and products.first_grid(v).first().path == "g/a"
    row = products.identification(n).first()
    assert (row.product_type, row.track, row.start) == ("GSLC", 77, None)


def test_runconfig():
    c = runconfig.interferogram("a.h5", "b.h5", "dem.tif", "out", 32611, (0, 1, 2, 3), {"runconfig": {"groups": {"processing": {"extra": 1}}}})
    p = c["runconfig"]["groups"]["processing"]
    assert p["extra"] == 1 and p["geocode"]["output_epsg"] == 32611 and runconfig.DEFAULT["runconfig"]["groups"]["processing"]["geocode"]["output_epsg"] is None
    assert runconfig.put({"a": {"b": 1}}, "a.c.d", 2) == {"a": {"b": 1, "c": {"d": 2}}}
    assert runconfig.utm_of("POLYGON ((-117 36, -116 36, -116 37, -117 37, -117 36))") == 32611
    assert runconfig.utm_of("POLYGON ((9 0, 9 0, 9 0, 9 0))") == 32632


def test_ingest_counts_each_file_once(spark, tmp_path):
    def drop(name, day):
        spark.sql(f"select 'p{day}' as product_id, timestamp '2025-01-{day:02d} 00:00:00' as t, id as r, id % 3 as c, 1.0D as re, 2.0D as im from range(9)").write.mode("append").parquet(str(tmp_path / "in"))

    args = [str(tmp_path / x) for x in ("in", "table", "check")]
    drop("a", 1)
    ingest.ingest(spark, *args, tile=4).awaitTermination()
    assert spark.read.parquet(args[1]).count() == 9
    drop("a", 1)
    drop("b", 13)
    ingest.ingest(spark, *args, tile=4).awaitTermination()
    assert spark.read.parquet(args[1]).count() == 18


def test_command_line(spark, px, tmp_path, capsys):
    px.write.parquet(str(tmp_path / "px"))
    assert cli.main([]) == 0 and "usage" in capsys.readouterr().out
    assert cli.main(["info", str(tmp_path / "px"), "--band", "real", "--window", "0", "4", "0", "30", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["mean"] == 1.5
    assert cli.main(["export", str(tmp_path / "px"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600
    with pytest.raises(SystemExit):
        cli.main(["info", str(tmp_path / "px"), "--window", "90", "91", "0", "1"])


def test_stacks(spark):
    px = spark.createDataFrame([("b", 0, 0, 1.0), ("a", 0, 0, 2.0), ("z", 0, 0, 3.0)], "path string, r long, c long, re double")
    entries = spark.sql("select * from values ('a', timestamp_ntz '2025-01-13', 1, 2, 0), ('b', timestamp_ntz '2025-01-01', 1, 2, 0), ('b', timestamp_ntz '2025-01-01', 1, 2, 0) as t(path, start, track, frame, group)")
    got = {r.path: r.t_idx for r in catalog.stack_pixels(px, catalog.stack_plan(entries)).collect()}
    assert got == {"b": 0, "a": 1}
    twice = entries.union(spark.sql("select 'c', timestamp_ntz '2025-01-01', 1, 2, 0"))
    with pytest.raises(ValueError, match="duplicate time"):
        catalog.stack_pixels(px, catalog.stack_plan(twice))
    mixed = entries.union(spark.sql("select 'c', timestamp_ntz '2025-02-01', 9, 2, 0"))
    assert {r.problem for r in catalog.stack_plan(mixed).collect()} == {"mixed track or frame"}


def test_hdf5_reader_makes_a_partition_a_chunk(monkeypatch):
    """The reader's arithmetic against a stand-in for the library, which need not be installed."""
    import sys
    import types

    import numpy as np

    z = np.arange(70).reshape(7, 10) * (1 + 2j)

    class Dataset:
        shape, chunks = z.shape, (4, 4)

        def __getitem__(self, key):
            return z[key]

    class File(dict):
        def __init__(self, path):
            super().__init__(d=Dataset())

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File))
    for window, box in ((None, (0, 7, 0, 10)), ("1,6,3,9", (1, 6, 3, 9))):
        reader = h5.Reader({"path": "p", "dataset": "d", "window": window})
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        r0, r1, c0, c1 = box
        assert {(r["r"], r["c"]): complex(r["re"], r["im"]) for r in rows} == {(i, j): z[i, j] for i in range(r0, r1) for j in range(c0, c1)}
        assert len(rows) == (r1 - r0) * (c1 - c0) and len(parts) == 6
