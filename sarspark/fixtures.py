"""Rasters derived from the star-schema tables by closed forms that hold at every scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLS = 32


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def slc_all(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, c, re, im): each vector is a line of 32 complex samples."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(COLS - 1))).alias("k"))
    return e.select("vec_id", "label", F.col("k").cast("long").alias("c"), F.get("embedding", F.col("k") * 2).cast("double").alias("re"), F.get("embedding", F.col("k") * 2 + 1).cast("double").alias("im"))


def slc(spark: SparkSession, d: str, img: int) -> DataFrame:
    """(r, c, re, im) of image 0 or 1."""
    return slc_all(spark, d).where(F.col("vec_id") % 2 == img).select(F.expr("vec_id div 2").alias("r"), "c", "re", "im")


def stack(spark: SparkSession, d: str) -> DataFrame:
    """(t, r, c, re, im): five acquisitions."""
    return slc_all(spark, d).select((F.col("vec_id") % 5).alias("t"), F.expr("vec_id div 5").alias("r"), "c", "re", "im")


def quadpol(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, hh_re, hh_im, hv_re, hv_im, vv_re, vv_im), one shuffle on the pixel."""
    x = slc_all(spark, d).withColumn("r", F.expr("vec_id div 3")).withColumn("p", F.col("vec_id") % 3)
    n = [F.max(F.when(F.col("p") == k, F.col(v))).alias(f"{name}_{v}") for k, name in enumerate(("hh", "hv", "vv")) for v in ("re", "im")]
    return x.groupBy("r", "c").agg(*n, F.count("*").alias("n")).where("n = 3").drop("n")


def mask_gslc(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, mask): 0 invalid, 255 fill, else a subswath."""
    x = slc_all(spark, d).where(F.col("vec_id") % 2 == 0)
    m = (F.col("label") + F.col("c")) % 10
    return x.select(F.expr("vec_id div 2").alias("r"), "c", F.when(m == 9, 255).otherwise(m).cast("long").alias("mask"))


def mask_gunw(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, mask): decimal digits water, reference and secondary subswath; 255 fill."""
    x = slc_all(spark, d).where(F.col("vec_id") % 2 == 0)
    m = (F.col("c") % 2) * 100 + (F.col("label") % 3) * 10 + F.col("c") % 3
    return x.select(F.expr("vec_id div 2").alias("r"), "c", F.when((F.col("label") + F.col("c")) % 11 == 0, 255).otherwise(m).cast("long").alias("mask"))


def conncomp(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, label), 0 where there is no component."""
    return slc_all(spark, d).where(F.col("vec_id") % 2 == 0).select(F.expr("vec_id div 2").alias("r"), "c", "label")


def phases(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, unw, iono): unwrapped phase and ionosphere screen."""
    a = slc(spark, d, 0).select("r", "c", (F.col("re") * F.pi()).alias("unw"))
    b = slc(spark, d, 1).select("r", "c", (F.col("re") * F.pi()).alias("iono"))
    return a.join(b, ["r", "c"])


def dem(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, x, y, elev) on a 30 m grid with heights in [800, 1000)."""
    k = F.col("p_partkey").cast("long")
    p = _t(spark, d, "part").select((F.expr("cast(p_partkey as bigint) div 50")).alias("r"), (k % 50).alias("c"), (F.col("p_retailprice") % 200 + 800).alias("elev"))
    return p.select("r", "c", (F.col("c") * 30.0 + 500000).alias("x"), (F.lit(4500000.0) - F.col("r") * 30.0).alias("y"), "elev")


def cube(spark: SparkSession, d: str, factor: float = 1.0) -> DataFrame:
    """(k, j, i, v) on heights 800, 900 and 1000 and a 5 by 5 grid over the elevation model."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    v = ((F.col("n") + 1) * 0.1 + F.col("k") * (F.col("g") + 1) * 0.05) * factor
    return n.select(F.col("k").cast("long").alias("k"), F.expr("n div 5").alias("j"), (F.col("n") % 5).alias("i"), v.alias("v"))


def granules(spark: SparkSession, d: str) -> DataFrame:
    """A catalog: (id, filename, url, product, track, frame, direction, start, stop, xmin, ymin, xmax, ymax)."""
    o = _t(spark, d, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"),
        F.expr("cast(o_custkey as bigint) % 173 + 1").alias("track"),
        F.expr("cast(o_orderkey as bigint) % 176 + 1").alias("frame"),
        F.when(F.col("o_orderstatus") == "O", "A").otherwise("D").alias("direction"),
        F.expr("cast(o_orderdate as timestamp_ntz) + interval 30 years").alias("start"),
        F.expr("cast(cast(o_orderkey as bigint) % 340 as double) - 170").alias("xmin"),
        F.expr("cast(cast(o_custkey as bigint) % 160 as double) - 80").alias("ymin"),
    )
    o = o.withColumn("stop", F.expr("start + interval 35 seconds")).withColumn("xmax", F.col("xmin") + 2).withColumn("ymax", F.col("ymin") + 1.5)
    stamp = "yyyyMMdd'T'HHmmss"
    name = F.concat(
        F.lit("NISAR_L2_PR_GSLC_001_"), F.lpad(F.col("track").cast("string"), 3, "0"), F.lit("_"), F.col("direction"), F.lit("_"), F.lpad(F.col("frame").cast("string"), 3, "0"),
        F.lit("_4005_DHDH_A_"), F.date_format("start", stamp), F.lit("_"), F.date_format("stop", stamp), F.lit("_X05009_N_F_J_001"),
    )
    o = o.withColumn("filename", F.concat(name, F.when(F.col("id") % 17 == 0, "_QA_STATS").otherwise(""), F.when(F.col("id") % 5 == 0, ".xml").otherwise(".h5")))
    return o.withColumn("product", F.lit("GSLC")).withColumn("url", F.concat(F.lit("https://data.example.org/"), "filename", F.when(F.col("id") % 3 == 0, "?sig=_QA_1").otherwise("")))


#: The same relations as DuckDB common table expressions.
SQL = {
    "v": "v AS (SELECT vec_id::BIGINT AS vec_id, label::BIGINT AS label, c::BIGINT AS c, embedding[2*c+1]::DOUBLE AS re, embedding[2*c+2]::DOUBLE AS im FROM embeddings, range(0, 32) t(c))",
    "a": "a AS (SELECT vec_id // 2 AS r, c, re, im FROM v WHERE vec_id % 2 = 0)",
    "b": "b AS (SELECT vec_id // 2 AS r, c, re, im FROM v WHERE vec_id % 2 = 1)",
    "p": "p AS (SELECT r, c, a.re AS re1, a.im AS im1, b.re AS re2, b.im AS im2, a.re*b.re + a.im*b.im AS re, a.im*b.re - a.re*b.im AS im FROM a JOIN b USING (r, c))",
    "s": "s AS (SELECT vec_id % 5 AS t, vec_id // 5 AS r, c, re, im FROM v)",
    "q": "q AS (SELECT vec_id // 3 AS r, c, " + ", ".join(f"max(CASE WHEN vec_id % 3 = {k} THEN {v} END) AS {n}_{v}" for k, n in enumerate(("hh", "hv", "vv")) for v in ("re", "im")) + " FROM v GROUP BY 1, 2 HAVING count(*) = 3)",
    "m": "m AS (SELECT vec_id // 2 AS r, c, CASE WHEN (label + c) % 10 = 9 THEN 255 ELSE (label + c) % 10 END AS mask FROM v WHERE vec_id % 2 = 0)",
    "g": "g AS (SELECT vec_id // 2 AS r, c, CASE WHEN (label + c) % 11 = 0 THEN 255 ELSE 100*(c % 2) + 10*(label % 3) + c % 3 END AS mask FROM v WHERE vec_id % 2 = 0)",
    "cc": "cc AS (SELECT vec_id // 2 AS r, c, label FROM v WHERE vec_id % 2 = 0)",
    "ph": "ph AS (SELECT r, c, a.re * pi() AS unw, b.re * pi() AS iono FROM a JOIN b USING (r, c))",
    "dem": "dem AS (SELECT r, c, 500000 + 30.0::DOUBLE * c AS x, 4500000 - 30.0::DOUBLE * r AS y, elev FROM (SELECT p_partkey::BIGINT // 50 AS r, p_partkey::BIGINT % 50 AS c, p_retailprice % 200 + 800 AS elev FROM part))",
    "cube": "cube AS (SELECT k::BIGINT AS k, n_nationkey::BIGINT // 5 AS j, n_nationkey::BIGINT % 5 AS i, 0.1::DOUBLE * (n_nationkey + 1) + k * 0.05::DOUBLE * (n_regionkey + 1) AS v FROM nation, range(0, 3) t(k))",
    "gr": """gr0 AS (SELECT o_orderkey::BIGINT AS id, o_custkey::BIGINT % 173 + 1 AS track, o_orderkey::BIGINT % 176 + 1 AS frame, CASE WHEN o_orderstatus = 'O' THEN 'A' ELSE 'D' END AS direction,
        o_orderdate::TIMESTAMP + INTERVAL 30 YEARS AS start, o_orderdate::TIMESTAMP + INTERVAL 30 YEARS + INTERVAL 35 SECONDS AS stop, (o_orderkey::BIGINT % 340)::DOUBLE - 170 AS xmin, (o_custkey::BIGINT % 160)::DOUBLE - 80 AS ymin FROM orders),
        gr1 AS (SELECT *, xmin + 2 AS xmax, ymin + 1.5::DOUBLE AS ymax, 'NISAR_L2_PR_GSLC_001_' || lpad(track::VARCHAR, 3, '0') || '_' || direction || '_' || lpad(frame::VARCHAR, 3, '0') || '_4005_DHDH_A_' || strftime(start, '%Y%m%dT%H%M%S') || '_' || strftime(stop, '%Y%m%dT%H%M%S')
        || '_X05009_N_F_J_001' || CASE WHEN id % 17 = 0 THEN '_QA_STATS' ELSE '' END || CASE WHEN id % 5 = 0 THEN '.xml' ELSE '.h5' END AS filename FROM gr0),
        gr AS (SELECT *, 'GSLC' AS product, 'https://data.example.org/' || filename || CASE WHEN id % 3 = 0 THEN '?sig=_QA_1' ELSE '' END AS url FROM gr1)""",
}
NEEDS = {"a": "v", "b": "v", "p": "a b", "s": "v", "q": "v", "m": "v", "g": "v", "cc": "v", "ph": "a b"}


def with_sql(names: str, body: str) -> str:
    """``body`` under the common table expressions that ``names`` (space-separated) need."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in NEEDS.get(n, "").split():
            need(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    return "WITH " + ", ".join(SQL[n] for n in order) + " " + body if order else body
