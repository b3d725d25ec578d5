"""The driver's `events` table as a tick feed with late arrivals and redeliveries made by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TICK_COLUMNS, ntz_micros


def events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type as symbol, value as price, user_id + 1 as size. Every 25th event arrives up to 1.5 hours late; every
    33rd is delivered again 1.5 seconds after."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    first = events.select(
        F.col("event_type").alias("symbol"),
        ntz_micros(F.col("ts")).alias("event_us"),
        F.col("value").alias("ltp"),
        (F.col("user_id") + 1).cast("double").alias("ltq"),
        F.col("event_id").alias("seq"),
    )
    delay = F.when(F.col("seq") % 25 == 0, ((F.col("seq") * 7919) % 5400 + 1) * 1_000_000).otherwise(0)
    # A redelivered event is one more row of the same scan.
    times = F.when(F.col("seq") % 33 == 0, F.array(F.lit(0), F.lit(1_500_000))).otherwise(F.array(F.lit(0)))
    return first.withColumn("_after", F.explode(times)).withColumn("arrival_us", F.col("event_us") + delay + F.col("_after")).select(*TICK_COLUMNS)
