"""Ticks as JSON records: the transport's value format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MICROS, TICK_COLUMNS

#: Fixed value: the record's fields. Times are seconds since the epoch.
RECORD = "symbol string, event_time decimal(20,6), arrival_time decimal(20,6), ltp double, ltq double, seq long"


def to_records(ticks: DataFrame, *kept: str) -> DataFrame:
    """(key, value): the symbol and the tick's JSON, as bytes; ticks of a symbol keep to one partition by their key."""
    seconds = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(MICROS).cast("decimal(20,0)")).cast("decimal(20,6)").alias
    row = F.struct("symbol", seconds("event_us")("event_time"), seconds("arrival_us")("arrival_time"), "ltp", "ltq", "seq")
    return ticks.select(*kept, F.encode("symbol", "UTF-8").alias("key"), F.encode(F.to_json(row, {"ignoreNullFields": "false"}), "UTF-8").alias("value"))


def from_records(records: DataFrame, *kept: str) -> DataFrame:
    """(value, ...) -> ticks; a missing arrival is the event's time, a missing seq is 0."""
    read = records.withColumn("_t", F.from_json(F.decode("value", "UTF-8"), RECORD))
    us = lambda c: (F.col(c) * MICROS).cast("long")
    return read.select(
        *kept,
        F.col("_t.symbol").alias("symbol"),
        us("_t.event_time").alias("event_us"),
        F.coalesce(us("_t.arrival_time"), us("_t.event_time")).alias("arrival_us"),
        F.col("_t.ltp").alias("ltp"),
        F.col("_t.ltq").alias("ltq"),
        F.coalesce("_t.seq", F.lit(0).cast("long")).alias("seq"),
    ).select(*kept, *TICK_COLUMNS)
