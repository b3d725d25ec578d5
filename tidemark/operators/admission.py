"""First-wins deduplication and watermark admission of ticks, as a per-record stream would decide them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import lateness_us, micros

#: Fixed value: the stream's watermark in seconds unless another is asked for.
DEFAULT_WATERMARK_S = 45.0
#: Time per bucket of the running maximum; ticks from which on a bucket is split; and into how many parts at most.
BUCKET_S = 3600.0
BUCKET_TICKS, BUCKET_PARTS = 200_000, 256
#: A bucket is split between slices of time.
SLICE_US = 1_000_000


def as_delivered(ticks: DataFrame) -> DataFrame:
    """Every delivery as a tick of its own, for feeds that repeat none or whose redeliveries should count."""
    return ticks


def deduplicate(ticks: DataFrame) -> DataFrame:
    """The earliest arrival of each (symbol, seq); of equal arrivals, the earliest event. Combined before the shuffle."""
    rest = [c for c in ticks.columns if c not in ("symbol", "seq", "arrival_us", "event_us")]
    first = F.min(F.struct("arrival_us", "event_us", *rest)).alias("_first")
    return ticks.groupBy("symbol", "seq").agg(first).select("symbol", "seq", "_first.*").select(*ticks.columns)


def redelivered(ticks: DataFrame) -> DataFrame:
    """Keys delivered more than once, with their number of deliveries."""
    return ticks.groupBy("symbol", "seq").agg(F.count("*").alias("deliveries")).filter("deliveries > 1")


def _stretch(time: str, bucket_s: float) -> Column:
    return F.floor(F.col(time) / F.lit(micros(bucket_s))).cast("long").alias("_stretch")


def is_busy(ticks: DataFrame, time: str = "arrival_us", keys: tuple[str, ...] = (), bucket_s: float = BUCKET_S) -> bool:
    """Whether some stretch of time (of a key) holds more than BUCKET_TICKS ticks: one row read, from counts per stretch.

    Rows that include others, such as all deliveries, answer for them too, and without a shuffle of rows."""
    most = ticks.groupBy(*keys, _stretch(time, bucket_s)).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) > BUCKET_TICKS


def in_buckets(
    ticks: DataFrame, time: str, keys: tuple[str, ...] = (), bucket_s: float = BUCKET_S, of: DataFrame | None = None, busy: bool | None = None
) -> DataFrame:
    """`ticks` with `_bucket`, numbers that grow with `time` (per key).

    A bucket is a fixed stretch of time; where it holds more than BUCKET_TICKS ticks, it is cut into parts of about as
    many ticks each, by counts per second. Only a single second is never split. The table of cuts has a row per stretch,
    and isn't made where no stretch is busy, which `busy` tells if it is known. Counts are of `of`, rows that include
    `ticks` and are read with less work; of `ticks` themselves if it isn't given.
    """
    of = ticks if of is None else of
    stretch = _stretch(time, bucket_s)
    if not (is_busy(of, time, keys, bucket_s) if busy is None else busy):
        return ticks.select("*", stretch.alias("_bucket"))
    counts = of.groupBy(*keys, stretch, F.floor(F.col(time) / SLICE_US).cast("long").alias("_slice")).agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys, "_stretch")
    before = F.coalesce(F.sum("_n").over(inside.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.greatest(F.lit(BUCKET_TICKS).cast("double"), F.sum("_n").over(inside) / BUCKET_PARTS)
    begins = counts.withColumn("_part", F.floor(before / size)).groupBy(*keys, "_stretch", "_part").agg(F.min("_slice").alias("_begin"))
    cuts = begins.filter("_part > 0").groupBy(*keys, "_stretch").agg(F.collect_list("_begin").alias("_cuts"))
    named = ticks.select("*", stretch).join(cuts, [*keys, "_stretch"], "left")
    part = F.size(F.filter("_cuts", lambda c: c <= F.floor(F.col(time) / SLICE_US)))
    bucket = F.col("_stretch") * 2 * BUCKET_PARTS + F.when(F.col("_cuts").isNull(), 0).otherwise(part)
    return named.withColumn("_bucket", bucket).drop("_stretch", "_cuts").select(*ticks.columns, "_bucket")


def with_previous_max(
    unique: DataFrame, bucket_s: float = BUCKET_S, keys: tuple[str, ...] = (), name: str = "prev_max_us", of: DataFrame | None = None, busy: bool | None = None
) -> DataFrame:
    """`name`: the greatest event time among ticks that arrived before, over all symbols or per key; null for the first.

    Arrivals fall into buckets of a bounded number of ticks (`of` and `busy` as there). A bucket's ticks are ordered in one
    task; what came before the bucket is a maximum over buckets, of which there are few.
    """
    named = in_buckets(unique, "arrival_us", keys, bucket_s, of, busy)
    order = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = named.groupBy(*keys, "_bucket").agg(F.max("event_us").alias("_most")).withColumn("_before", F.max("_most").over(order)).drop("_most")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("arrival_us", "seq", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    ran = named.withColumn("_within", F.max("event_us").over(inside)).join(heads, [*keys, "_bucket"])
    return ran.withColumn(name, F.greatest("_before", "_within")).drop("_bucket", "_before", "_within")


def is_late(watermark_us: Column | int) -> Column:
    """At or below the watermark; the first tick never is."""
    return F.coalesce(F.col("event_us") <= F.col("prev_max_us") - watermark_us, F.lit(False))


def admit(unique: DataFrame, watermark_s: float = DEFAULT_WATERMARK_S, of: DataFrame | None = None, busy: bool | None = None) -> DataFrame:
    """The ticks a stream with this watermark accepts."""
    return with_previous_max(unique, of=of, busy=busy).filter(~is_late(micros(watermark_s))).select(*unique.columns)


def verdicts(ticks: DataFrame, watermark_s: float = DEFAULT_WATERMARK_S) -> DataFrame:
    """Every delivery with its verdict: duplicate, late or accepted, checked in that order; and whether it is behind
    its symbol's newest accepted tick."""
    busy = is_busy(ticks)  # if no stretch is busy over all symbols, none is for a single one
    nth = Window.partitionBy("symbol", "seq").orderBy("arrival_us", "event_us", "ltp", "ltq")
    numbered = ticks.withColumn("_nth", F.row_number().over(nth))
    ran = with_previous_max(numbered.filter("_nth = 1").drop("_nth"), of=ticks, busy=busy)
    first = ran.withColumn("verdict", F.when(is_late(micros(watermark_s)), "late").otherwise("accepted"))
    again = numbered.filter("_nth > 1").drop("_nth").withColumn("prev_max_us", F.lit(None).cast("long")).withColumn("verdict", F.lit("duplicate"))
    accepted = with_previous_max(first.filter("verdict = 'accepted'"), keys=("symbol",), name="_newest", of=ticks, busy=busy)
    placed = accepted.withColumn("out_of_order", F.coalesce(F.col("event_us") < F.col("_newest"), F.lit(False))).drop("_newest")
    return placed.unionByName(first.filter("verdict = 'late'").unionByName(again).withColumn("out_of_order", F.lit(False)))


def stream_stats(ticks: DataFrame, watermark_s: float = DEFAULT_WATERMARK_S) -> DataFrame:
    """One row of counters over all deliveries."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts(ticks, watermark_s).agg(
        F.count("*").alias("seen"),
        count("accepted").alias("accepted"),
        count("duplicate").alias("duplicates"),
        count("late").alias("dropped_late"),
        F.count_if("out_of_order").alias("out_of_order"),
        F.max(F.when(F.col("verdict") == "accepted", F.col("event_us"))).alias("max_event_us"),
        F.max(lateness_us()).alias("max_lateness_us"),
    )


def least_exact_watermark_us(unique: DataFrame) -> DataFrame:
    """The greatest lag behind the running maximum: a watermark above it drops nothing."""
    lag = F.col("prev_max_us") - F.col("event_us")
    return with_previous_max(unique).agg(F.max(lag).alias("threshold_us"), F.max(lateness_us()).alias("max_lateness_us"))
