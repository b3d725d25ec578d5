"""Feed statistics, by exact ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import lateness_us
from .admission import BUCKET_S, deduplicate, in_buckets


def inversions(
    ticks: DataFrame,
    time: str = "event_us",
    keys: tuple[str, ...] = (),
    order: tuple[str, ...] = ("arrival_us", "seq", "symbol"),
    bucket_s: float = BUCKET_S,
    of: DataFrame | None = None,
) -> DataFrame:
    """Rows whose `time` is before that of the row next before them in `order`, over all rows or per key.

    Rows fall into buckets of a bounded number of rows by the first order column (from counts of `of`); each bucket is ordered in a task of its
    own, and its first row is compared with the last row of the bucket before it.
    """
    named = in_buckets(ticks, order[0], keys, bucket_s, of)
    place = F.struct(*order)
    tails = named.groupBy(*keys, "_bucket").agg(F.max_by(time, place).alias("_tail"))
    tails = tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")))
    before = F.lag(time).over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    joined = named.withColumn("_before", before).join(tails, [*keys, "_bucket"])
    return joined.filter(F.col(time) < F.coalesce("_before", "_tail")).drop("_bucket", "_tail", "_before")


def ranked(values: DataFrame, column: str, ranks: dict[str, str], width: int = 1_000_000) -> DataFrame:
    """One row: for each name, the value at a 0-based rank of the sorted column. A rank is an SQL expression over `n`.

    Values are counted, and the counts summed per range of `width`. The running count over ranges shows in which of
    them the ranks lie; only those are sorted. (Of microseconds, there are as many ranges as seconds.)
    """
    counts = values.groupBy(F.floor(F.col(column) / F.lit(width)).alias("_range"), F.col(column).alias("_value")).count()
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.groupBy("_range").agg(F.sum("count").alias("_held"))
    ranges = ranges.withColumn("_end", F.sum("_held").over(upto)).withColumn("n", F.sum("_held").over(Window.partitionBy()))
    lies = F.lit(False)
    for rank in ranks.values():
        lies = lies | ((F.expr(rank) < F.col("_end")) & (F.expr(rank) >= F.col("_end") - F.col("_held")))
    near = counts.join(ranges.filter(lies), "_range")
    inside = Window.partitionBy("_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ran = near.withColumn("_upto", F.col("_end") - F.col("_held") + F.sum("count").over(inside))
    hit = lambda rank: (F.expr(rank) < F.col("_upto")) & (F.expr(rank) >= F.col("_upto") - F.col("count"))
    return ran.agg(*(F.max(F.when(hit(rank), F.col("_value"))).alias(name) for name, rank in ranks.items()))


#: The ranks of the 99th percentile (the last for a single value) and of the median.
P99 = "CASE WHEN cast(floor(n * 0.99) AS bigint) - 1 < 0 THEN n - 1 ELSE cast(floor(n * 0.99) AS bigint) - 1 END"
MEDIAN = "n div 2"


def feed_statistics(ticks: DataFrame) -> DataFrame:
    """One row, all doubles; none for an empty feed. Lateness is of deduplicated ticks; the span is from the first to
    the last delivery's event."""
    unique = deduplicate(ticks)
    seconds = lambda c: (c / 1e6).alias
    total = ticks.agg(
        F.count("*").alias("ticks"),
        F.min_by("event_us", F.struct("arrival_us", "seq", "symbol")).alias("first_us"),
        F.max_by("event_us", F.struct("arrival_us", "seq", "symbol")).alias("last_us"),
    )
    one = unique.agg(F.count("*").alias("unique"), F.max(lateness_us()).alias("max_us"))
    turned = inversions(unique, of=ticks).agg(F.count("*").alias("out_of_order"))
    at = ranked(unique.select(lateness_us().alias("late")), "late", {"p99_us": P99, "median_us": MEDIAN})
    row = total.crossJoin(one).crossJoin(turned).crossJoin(at).filter("ticks > 0")
    return row.select(
        F.col("ticks").cast("double").alias("ticks"),
        F.col("unique").cast("double").alias("unique"),
        (F.col("ticks") - F.col("unique")).cast("double").alias("duplicates"),
        F.col("out_of_order").cast("double").alias("out_of_order"),
        (F.col("out_of_order") * 100.0 / F.col("unique")).alias("out_of_order_pct"),
        seconds(F.col("max_us"))("max_lateness_s"),
        seconds(F.col("p99_us"))("p99_lateness_s"),
        seconds(F.col("median_us"))("median_lateness_s"),
        ((F.col("last_us") - F.col("first_us")) / 6e7).alias("span_minutes"),
    )
