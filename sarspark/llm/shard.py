"""Proportional stratified interleaving into shards, in DataFrame functions only.

Rows of each source are ranked in seeded-shuffled order; a row's fractional rank is its rank
over its source's size. In the order of fractional ranks every stretch holds all sources in
the corpus' proportions, so equal cuts of it give shards that match the mixture, with counts
at most one apart. Both rankings are two-level: rows fall into many even buckets of a hash's
highest bits (or of the fractional rank), a table of bucket counts gives each bucket's first rank,
and only a bucket is sorted at a time. So no source, however large, meets in one task, and the
order is the hash's own, whatever the number of buckets and wherever the rows lie. Rows that are
alike in everything are one row with a count until they are placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Written, text_of

SHARDS = 24
SEED = 11
#: Rows that a bucket holds on average, while there are fewer than 2 to the power of BUCKET_BITS;
#: the table of bucket counts, which one task sums up, never has more rows than that (a source).
BUCKET_ROWS, BUCKET_BITS = 512, 16


def _offsets(rows: DataFrame, keys: list[str], bucket: str, size: Column) -> DataFrame:
    """keys, bucket, before (rows of the key in lower buckets) and total (rows of the key)."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(size).alias("n"))
    within = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("n").over(within.orderBy(bucket)) - F.col("n")
    return sums.select(*keys, bucket, before.alias("before"), F.sum("n").over(within).alias("total"))


def _each(rows: DataFrame, count: str) -> DataFrame:
    """``rows`` with ``copy`` from 0 to below ``count``, made in pieces, so that no array is long."""
    piece = 4096
    some = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(piece).cast("long"))))
    return some.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + piece, F.col(count)) - 1))).drop("from")


def interleave(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row, without its text.

    The size is the text's UTF-8 bytes plus 8. A null text is empty, a null source is a source
    of its own; an empty table gives an empty result. Rows that are alike in everything are placed
    one after the other in their source's order. Placement depends on the rows alone and not on their
    files or partitions.
    """
    text: Column = text_of(text_col)
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 1).alias("order"),
    )
    rows = Written(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies"))).df
    n = rows.agg(F.sum("copies")).first()[0] or 0
    bits = min(max(n // BUCKET_ROWS, 1).bit_length() - 1, BUCKET_BITS)
    # rank within the source, in the seeded order
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    rows = rows.withColumn("stratum", stratum).withColumn("bucket", F.shiftright("order", 63 - bits))
    first = _offsets(rows, ["stratum"], "bucket", F.col("copies")).withColumnsRenamed({"stratum": "of", "bucket": "of_bucket"})
    inside = Window.partitionBy("stratum", "bucket").orderBy("order", "id", "size", "crc")
    ranked = rows.withColumn("upto", F.sum("copies").over(inside)).join(first, (F.col("stratum") == F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
    ranked = _each(ranked.withColumn("ahead", F.col("before") + F.col("upto") - F.col("copies")), "copies")
    # (2 * rank + 1) / (2 * total): the middle of the row's part of its source
    fraction = (2.0 * (F.col("ahead") + F.col("copy")) + 1) / (2.0 * F.col("total"))
    placed = Written(ranked.select("id", "source", "size", "crc", "stratum", "order", fraction.alias("fraction")).withColumn("cut", F.floor(F.col("fraction") * (1 << bits)))).df
    cuts = _offsets(placed, [], "cut", F.lit(1)).select(F.col("cut").alias("of_cut"), "before")
    whole = Window.partitionBy("cut").orderBy("fraction", "stratum", "order", "id", "size", "crc")
    order = placed.withColumn("rank", F.row_number().over(whole)).join(cuts, F.col("cut") == F.col("of_cut"))
    at = (F.col("before") + F.col("rank") - 1).alias("at")
    order = order.select("id", "source", "size", "crc", at)
    exact = F.expr(f"(at * {shards}) div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return order.withColumn("shard", exact).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("at") - start).alias("slot")
    )
