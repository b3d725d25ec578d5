"""Synthetic sessions: the same distributions for the same seed, in any partitioning.

Every random number is a hash of (seed, symbol, tick, use), so ticks are made independently; gaps and price moves are
summed over each symbol's ticks, by stretches of STRETCH ticks and then over stretches. Arrivals carry lateness, small disorder and redeliveries at the profile's rates; a tick
that is late isn't also put out of order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MICROS, TICK_COLUMNS, micros

#: Symbols with their first prices, and the session's start.
SYMBOLS = {"IDEA": 7.5, "YESBANK": 21.0, "PNB": 104.0, "SUZLON": 58.0}
START_S = 1_700_000_000.0
#: Ticks of a symbol that one task sums.
STRETCH = 100_000


@dataclass(frozen=True)
class Profile:
    """The default rates and times."""

    out_of_order_rate: float = 0.10
    late_rate: float = 0.04
    max_lateness_s: float = 30.0
    duplicate_rate: float = 0.02
    mean_gap_s: float = 1.5


#: A feed with many late and disordered ticks.
NOISY = Profile(out_of_order_rate=0.15, late_rate=0.08, max_lateness_s=90.0, duplicate_rate=0.03)


def _uniform(seed: int, use: str) -> Column:
    """Above 0, below 1."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(use), F.col("symbol"), F.col("i")), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _gaussian(seed: int, use: str) -> Column:
    return F.sqrt(F.lit(-2.0) * F.log(_uniform(seed, use + "r"))) * F.cos(F.lit(2 * math.pi) * _uniform(seed, use + "a"))


def _running(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """`rows` with running sums over each symbol's ticks, in stretches of a bounded number of ticks."""
    named = rows.withColumn("_stretch", F.floor(F.col("i") / STRETCH))
    inside = Window.partitionBy("symbol", "_stretch").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    heads = named.groupBy("symbol", "_stretch").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    heads = heads.select("symbol", "_stretch", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))
    ran = named.withColumns({into: F.sum(c).over(inside) for c, into in sums.items()}).join(heads, ["symbol", "_stretch"])
    return ran.withColumns({into: F.col(into) + F.col(f"_{c}") for c, into in sums.items()}).drop("_stretch", *(f"_{c}" for c in sums))


def generate(spark: SparkSession, symbols: list[str], minutes: float, profile: Profile = Profile(), seed: int = 0, start_s: float = START_S) -> DataFrame:
    """Ticks of all symbols in arrival order."""
    # Enough gaps to fill the session but for a vanishing chance; ticks beyond its end are cut.
    mean = minutes * 60 / profile.mean_gap_s
    count = int(mean + 8 * math.sqrt(mean) + 16)
    names = F.create_map(*[x for s in symbols for x in (F.lit(s), F.lit(float(SYMBOLS.get(s, 50.0))))])
    rows = spark.range(count).select(F.col("id").alias("i"), F.explode(names).alias("symbol", "first"))
    gap = F.greatest(F.lit(1), F.round(F.lit(-profile.mean_gap_s * MICROS) * F.log(_uniform(seed, "gap")))).cast("long")
    size = F.exp(F.lit(4.0) + F.lit(0.9) * _gaussian(seed, "size")) * F.when(_uniform(seed, "burst") < 0.06, 8.0).otherwise(1.0)
    walked = _running(rows.withColumns({"gap": gap, "move": _gaussian(seed, "price")}), {"gap": "gone", "move": "moved"}).withColumn("event_us", F.col("gone") + micros(start_s))
    late, out = _uniform(seed, "late?") < profile.late_rate, _uniform(seed, "out?") < profile.out_of_order_rate
    delay = F.when(late, F.lit(1.0) + _uniform(seed, "late") * (profile.max_lateness_s - 1.0)).when(out, F.lit(0.001) + _uniform(seed, "out") * 0.399).otherwise(0.0)
    ticks = walked.filter(F.col("event_us") <= micros(start_s + minutes * 60)).select(
        "symbol",
        "i",
        "event_us",
        (F.col("event_us") + F.round(delay * MICROS).cast("long")).alias("arrival_us"),
        F.round(F.greatest(F.lit(0.05), F.col("first") * (F.lit(1.0) + F.lit(0.0004) * F.col("moved"))), 2).alias("ltp"),
        F.greatest(F.lit(1.0), F.floor(size).cast("double")).alias("ltq"),
        F.col("i").alias("seq"),
    )
    again = F.when(_uniform(seed, "dup?") < profile.duplicate_rate, F.array(F.lit(0).cast("long"), F.round((F.lit(0.05) + _uniform(seed, "dup") * 1.95) * MICROS).cast("long")))
    sent = ticks.withColumn("_after", F.explode(again.otherwise(F.array(F.lit(0).cast("long"))))).withColumn("arrival_us", F.col("arrival_us") + F.col("_after"))
    return sent.select(*TICK_COLUMNS).orderBy("arrival_us", "seq", "symbol")
