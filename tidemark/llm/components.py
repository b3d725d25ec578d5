"""Connected components of undirected links, by alternating large and small stars.

Each round is two grouped minima and two joins over the links, cut by a written table; no links reach the driver.
Skewed nodes are met by map-side minima and by joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Tables


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Large star: each node's larger neighbours move to its least one. Small star: its smaller ones and itself do."""
    if larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
    # links are (a < b): b's smaller neighbours are its a's.
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(a, b) of long ids -> (id, component): the least id reachable, for every id in a link between two ids."""
    spark = links.sparkSession
    tables = Tables(spark, name)
    now = tables.put("r0", links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    for i in range(1, max_rounds + 1):
        now = tables.put(f"r{i}", _stars(_stars(now, True), False))
        tables.drop(f"r{i - 1}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )
