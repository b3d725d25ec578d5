"""Schemas and time units. Times are whole microseconds since the epoch, so window edges are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000
#: Measures are summed as whole steps of 1/MEASURE_STEPS, so that sums don't depend on their order.
MEASURE_STEPS = 10_000

TICK = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("event_us", T.LongType(), False),
        T.StructField("arrival_us", T.LongType(), False),
        T.StructField("ltp", T.DoubleType(), True),
        T.StructField("ltq", T.DoubleType(), True),
        T.StructField("seq", T.LongType(), False),
    ]
)
TICK_COLUMNS = TICK.fieldNames()


def micros(seconds: float) -> int:
    return round(seconds * MICROS)


def ntz_micros(ts: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def steps(measure: Column) -> Column:
    """A measure as whole steps."""
    return F.round(measure * MEASURE_STEPS).cast("long")


def lateness_us() -> Column:
    return F.col("arrival_us") - F.col("event_us")
