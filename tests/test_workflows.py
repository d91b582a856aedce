"""Product files end to end, with a stand-in for the HDF5 library: tables, GeoTIFF, stacks, downloads, the command line."""

import json
import math
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarspark import cli
from sarspark.plans import workflows
from sarspark.sources import geotiff, opened, sinks
from sarspark.sources.geotiff import Grid

from . import standin

NAME = "NISAR_L2_PR_GSLC_004_077_A_024_4005_DHDH_A_202511{:02d}T124615_202511{:02d}T124650_X05009_N_F_J_001.h5"
RING = "POLYGON ((-117.1 36.1, -117.0 36.1, -117.0 36.2, -117.1 36.2, -117.1 36.1))"
NY, NX = 40, 30
RNG = np.random.default_rng(11)
SLC = (RNG.normal(size=(NY, NX)) + 1j * RNG.normal(size=(NY, NX))).astype("complex64")
Y, X = 4000000.0 - 30.0 * np.arange(NY), 500000.0 + 20.0 * np.arange(NX)


def gslc(image=SLC):
    mask = np.ones((NY, NX), "uint8")
    mask[5, 7], mask[6, 8] = 0, 255
    grid = {"xCoordinates": X, "yCoordinates": Y, "projection": np.bytes_(b"32611"), "HH": image, "HV": 2 * image, "mask": mask}
    own = {"productType": np.bytes_(b"GSLC"), "trackNumber": np.int32(77), "boundingPolygon": np.bytes_(RING.encode())}
    return {"science": {"LSAR": {"identification": own, "GSLC": {"grids": {"frequencyA": grid}}}}}


def gunw():
    axes = {"xCoordinates": X, "yCoordinates": Y, "projection": np.bytes_(b"32611")}
    phase = np.angle(SLC).astype("float32") * 3
    unwrapped = {**axes, "unwrappedPhase": phase, "coherenceMagnitude": np.abs(phase) / 10, "ionospherePhaseScreen": phase * 0 + 2}
    grids = {"unwrappedInterferogram": {"HH": unwrapped}, "wrappedInterferogram": {**axes, "HH": {"wrappedInterferogram": SLC}}}
    own = {"productType": np.bytes_(b"GUNW"), "referenceZeroDopplerStartTime": np.bytes_(b"2025-11-03T12:46:15"), "secondaryZeroDopplerStartTime": np.bytes_(b"2025-11-15T12:46:14")}
    return {"science": {"LSAR": {"identification": own, "GUNW": {"grids": {"frequencyA": grids}}}}}


@pytest.fixture
def files(spark, tmp_path, monkeypatch):
    standin.install(spark, tmp_path, monkeypatch)
    yield tmp_path
    sys.modules.pop("h5py", None)


def table(spark, z, origin=(0, 0)):
    r, c = np.indices(z.shape)
    rows = [(int(i) + origin[0], int(j) + origin[1], float(v.real), float(v.imag)) for i, j, v in zip(r.ravel(), c.ravel(), z.ravel())]
    return spark.createDataFrame(rows, "r long, c long, re double, im double")


@pytest.mark.parametrize("grid", [Grid((100.0, -2.0, NY), (5.0, 3.0, NX), 32611), Grid((36.0, 0.5, NY), (-117.0, 0.25, NX), 4326)])
@pytest.mark.parametrize("tile", [16, 512])
def test_geotiff_round_trip(spark, tmp_path, grid, tile):
    px = table(spark, SLC, (7, 9))
    z, back = geotiff.read(geotiff.write(px, ["re", "im"], tmp_path / "a" / "z.tif", grid, (7, 9), tile))
    assert back == grid and z.dtype == "complex64" and np.array_equal(z, SLC)
    path = geotiff.write(px.where("r < 7 + 16 and c <> 12"), ["re"], tmp_path / "re.tif", grid, (7, 9), tile)
    z, _ = geotiff.read(path)
    want = SLC.real.copy()
    want[16:], want[:, 3] = np.nan, np.nan
    assert np.array_equal(z, want, equal_nan=True) and [p.name for p in tmp_path.iterdir() if p.is_file()] == ["re.tif"]
    assert path.read_bytes()[:4] == b"II+\0"
    z, _ = geotiff.read(geotiff.write(px.limit(0), ["re"], path, grid))
    assert np.isnan(z).all()
    with pytest.raises(ValueError, match="not a raster"):
        (tmp_path / "no.tif").write_bytes(b"MM" + bytes(30))
        geotiff.read(tmp_path / "no.tif")


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    bad = table(spark, SLC).withColumn("re", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        geotiff.write(bad, ["re"], tmp_path / "z.tif", Grid((0.0, 1.0, NY), (0.0, 1.0, NX), 32611))
    assert list(tmp_path.iterdir()) == []


def test_a_product_as_tables(spark, files):
    product = opened.open_product(spark, standin.save(files / "a.h5", gslc()))
    assert product.kind == "GSLC" and product.polarizations() == ["HH", "HV"] and product.frequencies() == ["frequencyA"]
    grid = product.grid(product.group())
    assert grid == Grid((4000000.0, -30.0, NY), (500000.0, 20.0, NX), 32611)
    px, part, origin = product.slc("HV", box=(500100.0, 3999700.0, 500240.0, 3999910.0))
    got = {(p.r, p.c): complex(p.re, p.im) for p in px.collect()}
    assert set(got) == {(r, c) for r in range(3, 11) for c in range(5, 13)} and origin == (3, 5) and part == grid.part(3, 11, 5, 13)
    for (r, c), v in got.items():
        assert math.isnan(v.real) if (r, c) in ((5, 7), (6, 8)) else v == complex(2 * SLC[r, c])
    for bad, said in ((lambda: product.slc("VV"), "VV"), (lambda: product.slc(box=(0, 0, 1, 1)), "does not meet"), (lambda: product.band("coherence"), "no band"), (lambda: product.group("B"), "frequencyB")):
        with pytest.raises(ValueError, match=said):
            bad()
    with pytest.raises(FileNotFoundError):
        opened.open_product(spark, str(files / "none.h5"))
    (files / "b.h5").write_bytes(b"no product")
    with pytest.raises(ValueError, match="no product"):
        opened.open_product(spark, str(files / "b.h5"))
    pair = opened.open_product(spark, standin.save(files / "g.h5", gunw()))
    assert pair.bands() == list(opened.GUNW_BANDS) and pair.polarizations() == ["HH"]
    got = {(p.r, p.c): p.wrapped_phase for p in pair.band("wrapped_phase")[0].collect()}
    assert all(abs(got[r, c] - np.angle(SLC[r, c])) < 1e-6 for r, c in np.ndindex(NY, NX))


def test_command_line_of_products(spark, files, capsys):
    path, pair = standin.save(files / "a.h5", gslc()), standin.save(files / "g.h5", gunw())
    assert cli.main(["info", path, "--json"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["product_type"] == "GSLC" and found["trackNumber"] == "77" and found["frequencies"]["frequencyA"]["shape"] == [NY, NX] and found["frequencies"]["frequencyA"]["resolution"] == [20.0, 30.0]
    assert cli.main(["info", pair]) == 0
    text = capsys.readouterr().out
    assert "temporal_baseline_days: 11" in text and "coherence:" in text
    assert cli.main(["to-geotiff", path, "--output-dir", str(files / "out"), "--pol", "HV", "--bbox", "500100", "3999700", "500240", "3999910"]) == 0
    z, grid = geotiff.read(files / "out" / "a_amplitude_HV.tif")
    want = 20 * np.log10(np.abs(2 * SLC[3:11, 5:13]).astype(float))
    want[2, 2] = want[3, 3] = np.nan
    assert np.allclose(z, want, atol=1e-4, equal_nan=True) and grid.x == (500100.0, 20.0, 8)
    assert cli.main(["to-geotiff", pair]) == 0
    assert sorted(p.name for p in files.glob("*.tif")) == [f"g_{b}_HH.tif" for b in sorted(opened.GUNW_BANDS)]
    west, south, east, north = workflows.reproject(spark, (500100.0, 3999700.0, 500240.0, 3999910.0), 32611, back=True)
    assert cli.main(["to-geotiff", pair, "--band", "ionosphere", "--bbox-wgs84", *map(str, (west, south, east, north))]) == 0
    z, _ = geotiff.read(files / "g_ionosphere_HH.tif")
    assert 7 <= z.shape[0] <= 10 and 7 <= z.shape[1] <= 10 and (z == 2).all()
    for bad, said in (["to-geotiff", path, "--band", "coherence"], "no band"), (["to-geotiff", path, "--bbox", "0", "0", "1", "1"], "does not meet"), (["to-geotiff", path, "--pol", "VV"], "VV"), (["rslc-to-gunw", "x", "y", "--output-dir", str(files)], "x"):
        with pytest.raises(SystemExit, match=said):
            cli.main(bad)


def test_a_stack_of_images(spark, files):
    paths = [standin.save(files / NAME.format(d, d), gslc(SLC * d)) for d in (3, 15, 27)]
    (files / NAME.format(9, 9)).write_bytes(b"broken")
    paths.append(str(files / NAME.format(9, 9)))
    kept = files / "out" / "slcs" / "20251103.tif"
    kept.parent.mkdir(parents=True)
    kept.write_bytes(b"there")
    config, left = workflows.prepare_stack(spark, paths, files / "out", skip_dates={"20251127"}, overrides={"a.b": 3})
    found = workflows.load_config(config)
    assert [p.rpartition("/")[2] for p in found["slc_files"]] == ["20251103.tif", "20251115.tif"] and found["a"] == {"b": 3}
    assert {p for p, _ in left} == {paths[2], paths[3]} and kept.read_bytes() == b"there"
    z, _ = geotiff.read(files / "out" / "slcs" / "20251115.tif")
    want = SLC * 15
    want[5, 7] = want[6, 8] = np.nan
    assert np.array_equal(np.isnan(z), np.isnan(want)) and np.allclose(z[~np.isnan(z)], want[~np.isnan(want)])
    box = workflows.reproject(spark, (500100.0, 3999700.0, 500240.0, 3999910.0), 32611, back=True)
    workflows.prepare_stack(spark, paths[:1], files / "crop", aoi=box)
    assert geotiff.read(files / "crop" / "slcs" / "20251103.tif")[0].size < 120
    tool = [sys.executable, "-c", "import sys; a = sys.argv; open(a[a.index('--outfile') + 1], 'w').write('n: ' + str(a.index('--work-directory') - 2))"]
    assert workflows.load_config(workflows.prepare_stack(spark, paths[:1], files / "out", tool=tool, overrides={"k": 1})[0]) == {"n": 1, "k": 1}
    for bad, said in ((lambda: workflows.prepare_stack(spark, [], files), "no files"), (lambda: workflows.prepare_stack(spark, paths, files, skip_dates={"2025"}), "YYYYMMDD"), (lambda: workflows.prepare_stack(spark, paths[3:], files), "no file is left")):
        with pytest.raises(ValueError, match=said):
            bad()


def test_heights_and_pairs(spark, files):
    boxes = []

    def stitch(box, name):
        boxes.append(box)
        return np.arange(12.0).reshape(3, 4), Grid((box[3], -0.01, 3), (box[0], 0.01, 4), 4326)

    path = standin.save(files / "a.h5", gslc())
    px, grid = workflows.fetch_heights(spark, path, files / "dem.tif", stitch=stitch)
    assert boxes == [pytest.approx((-117.15, 36.05, -116.95, 36.25))] and px.count() == 12
    z, back = geotiff.read(files / "dem.tif")
    assert np.array_equal(z, np.arange(12.0).reshape(3, 4)) and back.epsg == 4326 and back.x[0] == pytest.approx(grid.x[0])
    assert px.where("r = 2 and c = 1").first().y == pytest.approx(36.23)
    w, s, e, n = workflows.bounds(spark, Grid((4000000.0, -30.0, NY), (500000.0, 20.0, NX), 32611), 0.0)
    assert -117.001 < w < e < -116.99 and 36.1 < s < n < 36.2
    made = []

    def work(config, restart):
        made.append((workflows.load_config(config), restart))
        (files / "run" / "product.h5").write_bytes(b"x")

    other = standin.save(files / "b.h5", gslc())
    assert workflows.pair_to_gunw(spark, path, other, files / "run", overrides={"runconfig": {"own": 1}}, restart=True, workflow=work, stitch=stitch).name == "product.h5"
    groups = made[0][0]["runconfig"]["groups"]
    assert groups["processing"]["geocode"]["output_epsg"] == 32611 and groups["dynamic_ancillary_file_group"]["dem_file"].endswith("dem.tif") and made[0][0]["runconfig"]["own"] == 1 and made[0][1]
    workflows.save_config({"runconfig": {"groups": {"mine": 5, "processing": {"keep": 1}}}}, files / "mine.yaml")
    workflows.pair_to_gunw(spark, path, other, files / "run", config=str(files / "mine.yaml"), dem=str(files / "dem.tif"), epsg=32611, box=(1.0, 2.0, 3.0, 4.0), workflow=work)
    groups = made[1][0]["runconfig"]["groups"]
    assert groups["mine"] == 5 and groups["processing"]["keep"] == 1 and groups["processing"]["geocode"]["top_left"] == {"x_abs": 1.0, "y_abs": 4.0} and "list_of_frequencies" not in str(groups)
    with pytest.raises(RuntimeError, match="without"):
        workflows.pair_to_gunw(spark, path, other, files / "none", dem="d.tif", epsg=32611, box=(1, 2, 3, 4), workflow=lambda *a: None)
    with pytest.raises(ImportError, match="nisar"):
        workflows.pair_to_gunw(spark, path, other, files / "none", dem="d.tif", epsg=32611, box=(1, 2, 3, 4))


def test_downloads(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "there.h5").write_bytes(b"good")
    (folder / "torn.h5").write_bytes(b"bad")
    (folder / "empty.bin").write_bytes(b"")
    tries = tmp_path / "tries"
    tries.mkdir()

    def stream(url, out, timeout):
        name = url.rpartition("/")[2]
        with (tries / name).open("a") as f:
            f.write("x")
        n = len((tries / name).read_text())
        out.write(b"half")
        if "gone" in name or ("slow" in name and n < 3):
            raise OSError(name)
        out.seek(0)
        out.write(b"bad!" if "rotten" in name or ("twice" in name and n < 2) else b"good")

    names = ["twice.h5", "there.h5", "torn.h5", "empty.bin", "gone.h5", "slow.bin", "rotten.h5"]
    plan = spark.createDataFrame([(n, f"http://x/{n}", n.endswith(".h5")) for n in names], "filename string, url string, validate boolean")
    got = {r.filename: r.status for r in sinks.download(plan, str(folder), pause=0.01, valid=lambda p: open(p, "rb").read() == b"good", stream=stream).collect()}
    assert got == {"empty.bin": "done", "gone.h5": "failed", "rotten.h5": "corrupted", "slow.bin": "done", "there.h5": "present", "torn.h5": "done", "twice.h5": "done"} and list(got) == sorted(got)
    assert {p.name for p in folder.iterdir()} == {"empty.bin", "slow.bin", "there.h5", "torn.h5", "twice.h5"}
    assert all(p.read_bytes() == b"good" for p in folder.iterdir())
    assert len((tries / "gone.h5").read_text()) == 3 and len((tries / "slow.bin").read_text()) == 3 and not (tries / "there.h5").exists()
    again = sinks.download(plan.where("filename = 'there.h5'"), str(folder), reprocess=True, stream=stream).first()
    assert again.status == "done" and len((tries / "there.h5").read_text()) == 1
    source = tmp_path / "src.bin"
    source.write_bytes(zlib.compress(bytes(1 << 20)))
    plan = spark.createDataFrame([("src.bin", source.as_uri(), False)], plan.schema)
    assert sinks.download(plan, str(folder)).first().status == "done" and (folder / "src.bin").read_bytes() == source.read_bytes()
