"""Connected components of an edge table by alternating large and small stars.

Each half round is written to the shared folder, so lineage stays short and joins read
plain scans that adaptive execution may split at hub nodes. Nothing is collected but a
count and a checksum of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = Written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = Written(both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    least.drop()
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = Written(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = Written(moved.union(least.df.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    least.drop()
    return out


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node reachable.

    Self loops and repeated edges are allowed; an empty table gives an empty result. Raises if
    the stars have not settled after ``max_rounds`` (they halve path lengths, so 64 is ample).
    """
    now = Written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now.df)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        large = _large_star(now.df)
        small = _small_star(large.df)
        large.drop()
        now.drop()
        now, last, mark = small, mark, _mark(small.df)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v"), F.col("v")).distinct())
