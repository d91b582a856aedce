"""Incremental ingest: new acquisitions append to a stack table as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "product_id string, t timestamp, r long, c long, re double, im double"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """New pixel files; a time that comes again within 30 days of the newest counts once."""
    px = spark.readStream.schema(SCHEMA).parquet(folder)
    return px.withWatermark("t", "30 days").dropDuplicatesWithinWatermark(["t", "r", "c"])


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, tile: int = 512) -> StreamingQuery:
    """Append what has arrived, by tile, and stop; the checkpoint makes each file count exactly once."""
    px = arrivals(spark, folder).withColumn("tile_r", F.expr(f"r div {tile}")).withColumn("tile_c", F.expr(f"c div {tile}"))
    return px.writeStream.format("parquet").partitionBy("tile_r", "tile_c").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
