"""Granule names, URLs, dates, boxes and searches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the product naming pattern and products
MISSION, STAMP = "NISAR", r"(\d{8}T\d{6})"
SEARCHABLE = ("RSLC", "GSLC", "GCOV", "RIFG", "RUNW", "GUNW", "ROFF", "GOFF")
READABLE = ("GSLC", "GUNW")
FREQUENCIES, POLARIZATIONS = ("frequencyA", "frequencyB"), ("HH", "HV", "VH", "VV")
FIRST_DATE = "2024-02-03"


def url_filename(url: Column) -> Column:
    """The last part of a URL's path, without its query."""
    return F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"[^/]*$", 0)


def parse_filename(name: Column) -> Column:
    """A granule name as a struct; null where it is no granule's name."""
    base = F.regexp_replace(F.regexp_extract(name, r"[^/]*$", 0), r"\.[A-Za-z0-9]+$", "")
    p = F.split(base, "_")
    times = F.regexp_extract_all(base, F.lit(STAMP), F.lit(1))
    qa = base.contains("_QA_")
    at = lambda k: F.get(p, F.lit(k))
    last = lambda k: F.get(p, F.size(p) - k)
    stamp = lambda k: F.try_to_timestamp(F.get(times, F.lit(k)), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    made = F.struct(
        at(1).alias("level"), at(3).alias("product"), at(4).alias("cycle"), at(5).cast("int").alias("track"),
        F.when(at(6) == "A", "Ascending").otherwise("Descending").alias("direction"), at(7).cast("int").alias("frame"),
        at(8).alias("mode"), at(9).alias("polarization"), stamp(0).alias("start"), stamp(1).alias("stop"),
        F.when(qa, last(6)).otherwise(last(4)).alias("crid"), qa.alias("is_qa"), (at(6) == "A").alias("is_ascending"),
    )
    return F.when((at(0) == MISSION) & (F.size(p) >= 13) & (F.size(times) >= 2), made)


def valid_url(url: Column) -> Column:
    return F.trim(url).rlike(r"^https?://[^/]+")


def bbox(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box with its corners in order; swapped ones are put right, out-of-range ones flagged."""
    return F.struct(
        F.least(x1, x2).alias("xmin"), F.least(y1, y2).alias("ymin"), F.greatest(x1, x2).alias("xmax"), F.greatest(y1, y2).alias("ymax"),
        ((x1 > x2) | (y1 > y2)).alias("swapped"), ((F.abs(x1) > 180) | (F.abs(x2) > 180) | (F.abs(y1) > 90) | (F.abs(y2) > 90)).alias("out_of_range"),
    )


def find_granules(catalog: DataFrame, box: tuple[float, float, float, float], start: str, stop: str, product: str = "GSLC", track: int | None = None, frame: int | None = None, direction: str | None = None, max_results: int | None = None, include_qa: bool = False) -> DataFrame:
    """Granules whose box and time meet the request; the limit comes before the file filter, by id."""
    if product not in SEARCHABLE:
        raise ValueError(f"unknown product {product}")
    x0, y0, x1, y1 = box
    found = catalog.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    found = found.where((F.col("start") >= F.lit(start).cast("timestamp_ntz")) & (F.col("start") <= F.lit(stop).cast("timestamp_ntz")) & (F.col("product") == product))
    for name, value in (("track", track), ("frame", frame), ("direction", direction)):
        if value is not None:
            found = found.where(F.col(name) == value)
    if max_results is not None:
        found = found.orderBy("id").limit(max_results)
    name = url_filename(F.col("url"))
    return found.where(name.endswith(".h5") & (F.lit(include_qa) | ~name.contains("_QA_")))


def download_plan(urls: DataFrame, present: DataFrame) -> DataFrame:
    """(filename, url, n_urls, validate) of what is to fetch: one URL a name (the last), without what is present."""
    named = urls.where(valid_url(F.col("url"))).select("id", F.trim("url").alias("url"), url_filename(F.trim("url")).alias("filename"))
    one = named.groupBy("filename").agg(F.max_by("url", "id").alias("url"), F.count("*").alias("n_urls"))
    return one.join(present, "filename", "left_anti").withColumn("validate", F.col("filename").endswith(".h5"))


def stack_plan(entries: DataFrame) -> DataFrame:
    """(path, start, t_idx, problem): unique paths in time order; equal times and mixed tracks are problems."""
    from pyspark.sql import Window

    one = entries.groupBy("path").agg(F.min("start").alias("start"), F.min("track").alias("track"), F.min("frame").alias("frame"), F.min("group").alias("group"))
    w = Window.partitionBy("group").orderBy("start", "path")
    same = Window.partitionBy("group", "start")
    whole = Window.partitionBy("group")
    mixed = (F.min("track").over(whole) != F.max("track").over(whole)) | (F.min("frame").over(whole) != F.max("frame").over(whole))
    problem = F.when(F.count("*").over(same) > 1, "duplicate time").when(mixed, "mixed track or frame")
    return one.select("group", "path", "start", (F.row_number().over(w) - 1).cast("long").alias("t_idx"), problem.alias("problem"))


def format_bytes(n: Column) -> Column:
    """1024 steps, one decimal."""
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < float(1 << (10 * (k + 1))), F.format_string(f"%.1f {unit}", n / float(1 << (10 * k)))).otherwise(out)
    return out


def stack_pixels(px: DataFrame, plan: DataFrame) -> DataFrame:
    """Pixels (path, r, c, ...) of planned acquisitions with their t_idx and start; raises if the plan has a problem.

    The plan has a row per file, so its written or cached size decides whether it is broadcast.
    """
    bad = plan.where(F.col("problem").isNotNull()).select("path", "problem").first()
    if bad is not None:
        raise ValueError(f"{bad['path']}: {bad['problem']}")
    return px.join(plan.select("path", "t_idx", "start"), "path")
