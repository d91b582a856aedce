"""The command line: ``python -m sarspark.cli info|to-geotiff|rslc-to-gunw|export ...``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .operators import sar
from .plans import workflows
from .plans.raster_queries import stats
from .session import local_session
from .sources import geotiff, sinks
from .sources.catalog import POLARIZATIONS
from .sources.opened import GSLC_BANDS, GUNW_BANDS, open_product

BANDS = {"amplitude": lambda: sar.to_db(F.sqrt(F.expr("re*re + im*im")), power=False), "wrapped_phase": lambda: sar.phase(F.col("re"), F.col("im")), "real": lambda: F.col("re")}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sarspark", description="Radar products and raster tables: summaries, exports and workflows.")
    sub = top.add_subparsers(dest="command", metavar="<command>")
    info = sub.add_parser("info", help="summary of a product file, or of a band of a pixel table")
    export = sub.add_parser("export", help="write a band as a tiled table")
    for p, what in ((info, "product file (.h5) or Parquet pixel table"), (export, "Parquet pixel table with r, c, re, im")):
        p.add_argument("pixels", help=what)
        p.add_argument("--band", choices=sorted(BANDS), default="amplitude")
        p.add_argument("--window", nargs=4, type=int, metavar=("R0", "R1", "C0", "C1"))
    info.add_argument("--json", action="store_true")
    export.add_argument("output")

    tif = sub.add_parser("to-geotiff", help="write bands of a product file as GeoTIFF", description="Files are named <product>_<band>_<polarization>.tif; without --band all bands of the product are written.")
    tif.add_argument("product")
    tif.add_argument("--band", choices=sorted({*GSLC_BANDS, *GUNW_BANDS}))
    tif.add_argument("--pol", choices=sorted(POLARIZATIONS), help="the first that there is")
    tif.add_argument("--freq", default="A")
    tif.add_argument("--output-dir", help="the product's folder")
    box = tif.add_mutually_exclusive_group()
    box.add_argument("--bbox", nargs=4, type=float, metavar=("XMIN", "YMIN", "XMAX", "YMAX"), help="in the product's own coordinates")
    box.add_argument("--bbox-wgs84", nargs=4, type=float, metavar=("WEST", "SOUTH", "EAST", "NORTH"))

    pair = sub.add_parser("rslc-to-gunw", help="run the installed interferogram workflow on a pair")
    pair.add_argument("reference")
    pair.add_argument("secondary")
    pair.add_argument("--output-dir", required=True)
    pair.add_argument("--runconfig")
    pair.add_argument("--dem")
    pair.add_argument("--bbox", nargs=4, type=float, metavar=("XMIN", "YMIN", "XMAX", "YMAX"), help="in projected coordinates")
    pair.add_argument("--epsg", type=int)
    pair.add_argument("--restart", action="store_true")
    return top


def text_of(found: dict, indent: int = 0) -> str:
    """Keys and values as lines; mappings in a block of their own."""
    width = max((len(str(k)) for k, v in found.items() if not isinstance(v, dict)), default=0)
    lines = []
    for k, v in found.items():
        start = " " * indent
        lines.append(f"{start}{k}:\n{text_of(v, indent + 2)}" if isinstance(v, dict) else f"{start}{k:>{width}}: {', '.join(map(str, v)) if isinstance(v, list) else v}")
    return "\n".join(lines)


def to_geotiff(a: argparse.Namespace) -> None:
    spark = local_session()
    product = open_product(spark, str(Path(a.product).expanduser()))
    pol = a.pol or product.polarizations(a.freq)[0]
    folder = Path(a.output_dir or Path(product.path).parent)
    for band in [a.band] if a.band else product.bands():
        box = tuple(a.bbox) if a.bbox else None
        if a.bbox_wgs84:
            _, grid, _ = product.band(band, pol, a.freq)
            box = workflows.reproject(spark, tuple(a.bbox_wgs84), grid.epsg)
        px, grid, origin = product.band(band, pol, a.freq, box)
        print(geotiff.write(px, [band], folder / f"{Path(product.path).stem}_{band}_{pol}.tif", grid, origin))


def info(a: argparse.Namespace) -> None:
    spark = local_session()
    if Path(a.pixels).suffix.lower() in (".h5", ".hdf5"):
        found = open_product(spark, a.pixels).summary()
    else:
        found = stats(_band(spark, a), a.band).first().asDict()
    print(json.dumps(found, default=str) if a.json else text_of(found))


def _band(spark, a: argparse.Namespace):
    px = spark.read.parquet(a.pixels)
    if a.window:
        r0, r1, c0, c1 = a.window
        px = px.where(f"r >= {r0} and r < {r1} and c >= {c0} and c < {c1}")
        if not px.take(1):
            raise ValueError("the window holds no pixel")
    return px.select("r", "c", BANDS[a.band]().alias(a.band))


def export(a: argparse.Namespace) -> None:
    sinks.write_pixels(_band(local_session(), a), a.output)


def rslc_to_gunw(a: argparse.Namespace) -> None:
    box = tuple(a.bbox) if a.bbox else None
    print("GUNW:", workflows.pair_to_gunw(local_session(), a.reference, a.secondary, a.output_dir, a.runconfig, a.dem, box, a.epsg, restart=a.restart))


def main(args: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(args)
    if a.command is None:
        top.print_help()
        return 0
    try:
        {"info": info, "export": export, "to-geotiff": to_geotiff, "rslc-to-gunw": rslc_to_gunw}[a.command](a)
    except (ValueError, ImportError, FileNotFoundError) as e:
        sys.exit(str(e))
    return 0


if __name__ == "__main__":
    sys.exit(main())
