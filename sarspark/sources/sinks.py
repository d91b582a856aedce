"""Writing rasters: tiled Parquet by default, other formats where their library is installed."""

from __future__ import annotations

import shutil
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from http.client import HTTPException
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Written
from .h5 import need

TILE = 512


def with_tiles(px: DataFrame, tile: int = TILE) -> DataFrame:
    return px.withColumn("tile_r", F.expr(f"r div {tile}")).withColumn("tile_c", F.expr(f"c div {tile}"))


def write_pixels(px: DataFrame, path: str, tile: int = TILE, append: bool = False) -> None:
    """Pixels partitioned by tile, one shuffle on the tile; a window then reads only the tiles it meets."""
    tiled = with_tiles(px, tile).repartition("tile_r", "tile_c")
    tiled.write.mode("append" if append else "overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def read_pixels(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, tile: int = TILE) -> DataFrame:
    """Pixels of a window (r0, r1, c0, c1; ends excluded); the tile predicate prunes partitions."""
    px = spark.read.parquet(path)
    if window:
        r0, r1, c0, c1 = window
        px = px.where(F.col("tile_r").between(r0 // tile, (r1 - 1) // tile) & F.col("tile_c").between(c0 // tile, (c1 - 1) // tile))
        px = px.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    return px.drop("tile_r", "tile_c")


def split_complex(px: DataFrame, name: str) -> DataFrame:
    return px.withColumnsRenamed({"re": f"{name}_real", "im": f"{name}_imag"})


def merge_complex(px: DataFrame, name: str) -> DataFrame:
    """The inverse; a part without its other is passed through as it is."""
    if f"{name}_real" in px.columns and f"{name}_imag" in px.columns:
        return px.withColumnsRenamed({f"{name}_real": "re", f"{name}_imag": "im"})
    return px


def render_frame(px: DataFrame, value: str, ny: int, nx: int, most: int = 1000) -> pd.DataFrame:
    """A raster decimated by block means to at most ``most`` pixels a side, for a plot."""
    from ..operators.sar import multilook

    step = max(1, -(-ny // most), -(-nx // most))
    return multilook(px, [value], step, step, ny, nx).toPandas().pivot(index="lr", columns="lc", values=value)


def _stream(url: str, out: BinaryIO, timeout: float) -> None:
    with urllib.request.urlopen(url, timeout=timeout) as body:
        shutil.copyfileobj(body, out, 1 << 18)


def download(
    plan: DataFrame, folder: str, reprocess: bool = False, parallel: int = 4, retries: int = 3, timeout: float = 60, pause: float = 1.5,
    valid: Callable[[str], bool] | None = None, stream: Callable[[str, BinaryIO, float], None] = _stream,
) -> DataFrame:
    """Fetch each row of a download plan into a folder that all tasks reach; (filename, status) by name.

    A file that is there and not empty is kept (``present``) unless ``reprocess``. A body goes to a file of
    its own that takes the name once it is whole, so nothing half-written is ever seen; a failed request is
    tried again after a pause. Of rows marked ``validate`` a file that ``valid`` refuses is removed and
    fetched once more; then it is ``corrupted`` and gone.
    """

    def one(name: str, url: str) -> bool:
        for attempt in range(retries):
            time.sleep(pause if attempt else 0)
            own = Path(folder) / f".{name}.{uuid.uuid4().hex}"
            try:
                with own.open("wb") as out:
                    stream(url, out, timeout)
                own.replace(Path(folder) / name)
                return True
            except (OSError, HTTPException):
                continue
            finally:
                own.unlink(missing_ok=True)
        return False

    def status(name: str, url: str, checked: bool) -> str:
        path = Path(folder) / name
        there = not reprocess and path.exists() and path.stat().st_size > 0
        for _ in range(2):
            if not there and not one(name, url):
                return "failed"
            if not checked or valid is None or valid(str(path)):
                return "present" if there else "done"
            path.unlink()
            there = False
        return "corrupted"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for batch in batches:
            found = [(n, status(n, u, c)) for n, u, c in zip(batch["filename"], batch["url"], batch["validate"])]
            yield pd.DataFrame(found, columns=["filename", "status"])

    found = plan.select("filename", "url", "validate").repartition(parallel).mapInPandas(run, "filename string, status string")
    return Written(found).df.orderBy("filename")  # written first: a sort samples its input, which would fetch twice


def write_netcdf(px: pd.DataFrame, path: str) -> None:
    """A small pixel frame as NetCDF."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    need("xarray").Dataset.from_dataframe(px.set_index(["r", "c"])).to_netcdf(path)
