"""Queries over catalogs, names, URLs and product summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import with_sql
from ..functions import geodesy as geo
from ..sources import catalog as cat
from .registry import query

S = SparkSession
_FROM, _TO = "2022-01-01", "2026-12-31"


@query(
    with_sql(
        "gr",
        """SELECT id, f[6]::INT AS track, f[8]::INT AS frame, CASE WHEN f[7] = 'A' THEN 'Ascending' ELSE 'Descending' END AS direction, f[4] AS product, strptime(f[12], '%Y%m%dT%H%M%S')::TIMESTAMP AS start, f[len(f) - CASE WHEN qa THEN 5 ELSE 3 END] AS crid, qa AS is_qa
        FROM (SELECT id, string_split(regexp_replace(filename, '\\.[a-z0-9]+$', ''), '_') AS f, contains(filename, '_QA_') AS qa FROM gr)""",
    )
)
def parse_filename(spark: S, d: str) -> DataFrame:
    x = fx.granules(spark, d).select("id", cat.parse_filename(F.col("filename")).alias("f"))
    return x.select("id", "f.track", "f.frame", "f.direction", "f.product", "f.start", "f.crid", "f.is_qa")


@query(
    with_sql(
        "gr",
        f"""SELECT id, url FROM (SELECT *, regexp_extract(regexp_extract(url, '^[^?#]*', 0), '[^/]*$', 0) AS n FROM (SELECT * FROM gr WHERE xmin <= 40 AND xmax >= -100 AND ymin <= 60 AND ymax >= -20 AND start >= TIMESTAMP '{_FROM}' AND start <= TIMESTAMP '{_TO}' AND direction = 'A' ORDER BY id LIMIT 500))
        WHERE ends_with(n, '.h5') AND NOT contains(n, '_QA_')""",
    )
)
def find_granules(spark: S, d: str) -> DataFrame:
    return cat.find_granules(fx.granules(spark, d), (-100, -20, 40, 60), _FROM, _TO, direction="A", max_results=500).select("id", "url")


@query("SELECT page_id, regexp_extract(regexp_extract(url, '^[^?#]*', 0), '[^/]*$', 0) AS filename FROM pages")
def url_filename(spark: S, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", cat.url_filename(F.col("url")).alias("filename"))


@query("SELECT page_id, regexp_matches(trim(url), '^https?://[^/]+') AS valid FROM pages")
def validate_urls(spark: S, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", cat.valid_url(F.col("url")).alias("valid"))


@query(
    with_sql(
        "gr",
        "SELECT filename, max_by(url, id) AS url, count(*) AS n_urls, ends_with(filename, '.h5') AS validate FROM gr WHERE filename NOT IN (SELECT filename FROM gr WHERE id % 4 = 0) GROUP BY filename",
    )
)
def download_plan(spark: S, d: str) -> DataFrame:
    g = fx.granules(spark, d)
    return cat.download_plan(g.select("id", "url"), g.where("id % 4 = 0").select("filename").distinct())


_STACK = "st AS (SELECT DISTINCT track AS g, filename AS path, start, track, frame FROM gr WHERE id % 5 <> 0 AND id % 17 <> 0)"


@query(
    with_sql("gr", "SELECT 1").removesuffix(" SELECT 1")
    + f", {_STACK} SELECT g AS \"group\", path, start, row_number() OVER (PARTITION BY g ORDER BY start, path) - 1 AS t_idx, CASE WHEN count(*) OVER (PARTITION BY g, start) > 1 THEN 'duplicate time' WHEN min(frame) OVER (PARTITION BY g) <> max(frame) OVER (PARTITION BY g) THEN 'mixed track or frame' END AS problem FROM st"
)
def stack_gslcs(spark: S, d: str) -> DataFrame:
    g = fx.granules(spark, d).where("id % 5 <> 0 and id % 17 <> 0")
    return cat.stack_plan(g.select(F.col("track").alias("group"), F.col("filename").alias("path"), "start", "track", "frame"))


@query(with_sql("gr", "SELECT track, count(*) AS n, count(DISTINCT frame) AS n_frames, count(*) - count(DISTINCT start) AS n_repeated, count(DISTINCT frame) = 1 AND count(*) = count(DISTINCT start) AS consistent FROM gr GROUP BY 1"))
def stack_validate(spark: S, d: str) -> DataFrame:
    x = fx.granules(spark, d).groupBy("track").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("n_frames"), F.countDistinct("start").alias("n_starts"))
    return x.select("track", "n", "n_frames", (F.col("n") - F.col("n_starts")).alias("n_repeated"), ((F.col("n_frames") == 1) & (F.col("n") == F.col("n_starts"))).alias("consistent"))


@query(with_sql("gr", "SELECT id, filename, replace(filename, '.h5', '_HH.tif') AS target FROM gr WHERE ends_with(filename, '.h5') AND NOT contains(filename, '_QA_') AND strftime(start, '%Y%m%d') NOT IN (SELECT strftime(start, '%Y%m%d') FROM gr WHERE id % 50 = 0) AND id % 3 <> 0"))
def prep_stack_plan(spark: S, d: str) -> DataFrame:
    """What a preparation run has to write: valid granules, not on skipped dates, not there yet."""
    g = fx.granules(spark, d).withColumn("day", F.date_format("start", "yyyyMMdd"))
    skip = g.where("id % 50 = 0").select("day").distinct()
    there = g.where("id % 3 = 0").select("id")
    x = g.where(F.col("filename").endswith(".h5") & ~F.col("filename").contains("_QA_")).join(skip, "day", "left_anti").join(there, "id", "left_anti")
    return x.select("id", "filename", F.replace("filename", F.lit(".h5"), F.lit("_HH.tif")).alias("target"))


@query("SELECT id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180)/6)::BIGINT + 1 AS epsg FROM (SELECT o_orderkey::BIGINT AS id, (o_orderkey::BIGINT % 340)::DOUBLE - 170 AS lon, (o_custkey::BIGINT % 160)::DOUBLE - 80 AS lat FROM orders)")
def utm_epsg(spark: S, d: str) -> DataFrame:
    return fx.granules(spark, d).select("id", F.expr(geo.utm_epsg("xmin", "ymin")).alias("epsg"))


@query("SELECT id, TRY_CAST(trim(v) AS BIGINT) AS epsg FROM (SELECT o_orderkey::BIGINT AS id, CASE o_orderkey % 3 WHEN 0 THEN ' 326' || lpad((o_orderkey % 60 + 1)::VARCHAR, 2, '0') || ' ' WHEN 1 THEN '4326' ELSE 'unknown' END AS v FROM orders)")
def extract_epsg(spark: S, d: str) -> DataFrame:
    i = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"))
    v = F.expr("case id % 3 when 0 then concat(' 326', lpad(cast(id % 60 + 1 as string), 2, '0'), ' ') when 1 then '4326' else 'unknown' end")
    return i.select("id", F.trim(v).try_cast("long").alias("epsg"))


@query(f"SELECT id, start < stop AND start >= TIMESTAMP '{cat.FIRST_DATE}' AS valid, start FROM (SELECT o_orderkey::BIGINT AS id, o_orderdate::TIMESTAMP + INTERVAL 30 YEARS AS start, o_orderdate::TIMESTAMP + INTERVAL 30 YEARS + ((o_orderkey % 3) - 1) * INTERVAL 1 DAY AS stop FROM orders)")
def validate_dates(spark: S, d: str) -> DataFrame:
    g = fx.granules(spark, d).withColumn("stop", F.expr("start + make_dt_interval(cast(id % 3 as int) - 1)"))
    return g.select("id", ((F.col("start") < F.col("stop")) & (F.col("start") >= F.lit(cat.FIRST_DATE).cast("timestamp_ntz"))).alias("valid"), "start")


@query("SELECT id, least(a, c) AS xmin, least(b, e) AS ymin, greatest(a, c) AS xmax, greatest(b, e) AS ymax, a > c OR b > e AS swapped, abs(a) > 180 OR abs(c) > 180 OR abs(b) > 90 OR abs(e) > 90 AS out_of_range FROM (SELECT o_orderkey::BIGINT AS id, (o_orderkey::BIGINT % 380)::DOUBLE - 190 AS a, (o_custkey::BIGINT % 190)::DOUBLE - 95 AS b, (o_orderkey::BIGINT % 371)::DOUBLE - 185 AS c, (o_custkey::BIGINT % 181)::DOUBLE - 90 AS e FROM orders)")
def normalize_bbox(spark: S, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("cast(o_orderkey as bigint) as id", "cast(o_custkey as bigint) as k")
    p = [F.expr(e) for e in ("cast(id % 380 as double) - 190", "cast(k % 190 as double) - 95", "cast(id % 371 as double) - 185", "cast(k % 181 as double) - 90")]
    return o.select("id", cat.bbox(*p).alias("b")).select("id", "b.*")


@query("SELECT id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n/1024) WHEN n < 1073741824 THEN printf('%.1f MB', n/1048576) WHEN n < 1099511627776 THEN printf('%.1f GB', n/1073741824) ELSE printf('%.1f TB', n/1099511627776) END AS text FROM (SELECT o_orderkey::BIGINT AS id, pow(2e0, (o_orderkey % 45)::DOUBLE) * 1.3e0 AS n FROM orders)")
def format_bytes(spark: S, d: str) -> DataFrame:
    i = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"))
    return i.select("id", cat.format_bytes(F.pow(F.lit(2.0), (F.col("id") % 45).cast("double")) * 1.3).alias("text"))


@query(with_sql("gr", "SELECT id, product, track, frame, CASE WHEN direction = 'A' THEN 'Ascending' ELSE 'Descending' END AS direction, start, 35 AS seconds FROM gr"))
def orbit_info(spark: S, d: str) -> DataFrame:
    g = fx.granules(spark, d)
    seconds = F.expr("cast(timestampdiff(SECOND, start, stop) as int)")
    return g.select("id", "product", "track", "frame", F.when(F.col("direction") == "A", "Ascending").otherwise("Descending").alias("direction"), "start", seconds.alias("seconds"))


@query(with_sql("gr", "SELECT id, xmin, ymin, xmax, ymax, round(3e0, 6) AS area FROM gr"))
def polygon_bounds(spark: S, d: str) -> DataFrame:
    """Bounds and area (shoelace) of a WKT ring."""
    ring = F.expr("concat('POLYGON ((', concat_ws(', ', concat(xmin, ' ', ymin), concat(xmax, ' ', ymin), concat(xmax, ' ', ymax), concat(xmin, ' ', ymax), concat(xmin, ' ', ymin)), '))')")
    g = fx.granules(spark, d).select("id", ring.alias("wkt"))
    return polygon(g, "wkt").select("id", "xmin", "ymin", "xmax", "ymax", F.round("area", 6).alias("area"))


def polygon(df: DataFrame, wkt: str) -> DataFrame:
    """``df`` with bounds and area of a polygon's outer ring."""
    points = F.regexp_extract_all(F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1), F.lit(r"(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)"), F.lit(0))
    ring = F.transform(points, lambda p: F.struct(F.get(F.split(p, r"\s+"), F.lit(0)).cast("double").alias("x"), F.get(F.split(p, r"\s+"), F.lit(1)).cast("double").alias("y")))
    x = df.withColumn("ring", ring)
    pairs = F.transform(F.slice("ring", F.lit(2), F.size("ring") - 1), lambda p, i: F.get("ring", i)["x"] * p["y"] - p["x"] * F.get("ring", i)["y"])
    ends = {f"{v}{n}": f(F.col("ring")[v]) for v in ("x", "y") for n, f in (("min", F.array_min), ("max", F.array_max))}
    return x.withColumns(ends | {"area": F.abs(F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)) / 2}).drop("ring")


@query(with_sql("gr", "SELECT product, count(*) AS n, count(DISTINCT track) AS n_tracks, min(start) AS first_start, max(stop) AS last_stop, count(*) FILTER (WHERE contains(filename, '_QA_')) AS n_qa, min(xmin) AS xmin, max(xmax) AS xmax FROM gr GROUP BY 1"))
def info_gslc(spark: S, d: str) -> DataFrame:
    g = fx.granules(spark, d)
    return g.groupBy("product").agg(
        F.count("*").alias("n"), F.countDistinct("track").alias("n_tracks"), F.min("start").alias("first_start"), F.max("stop").alias("last_stop"),
        F.count_if(F.col("filename").contains("_QA_")).alias("n_qa"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"),
    )


@query(with_sql("gr", "SELECT a.id, b.id AS secondary, floor(epoch(b.start - a.start)/86400)::BIGINT AS temporal_baseline_days FROM gr a JOIN gr b ON a.track = b.track AND a.frame = b.frame AND a.start < b.start"))
def info_gunw(spark: S, d: str) -> DataFrame:
    """Pairs of a track and frame with their temporal baseline in whole days."""
    g = fx.granules(spark, d)
    a = g.select("track", "frame", "id", F.col("start").alias("s1"))
    b = g.select("track", "frame", F.col("id").alias("secondary"), F.col("start").alias("s2"))
    days = F.expr("cast(floor(timestampdiff(SECOND, s1, s2) / 86400) as bigint)")
    return a.join(b, ["track", "frame"]).where("s1 < s2").select("id", "secondary", days.alias("temporal_baseline_days"))
