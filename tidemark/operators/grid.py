"""Evaluation instants: a regular grid over all symbols."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import micros


@dataclass(frozen=True)
class Span:
    """The first instant and the number of steps after it; no instants if `steps` is negative."""

    start_us: int = 0
    steps: int = -1


@dataclass(frozen=True)
class Grid:
    """Every `step_s` seconds from the first event plus `warmup_s` to the last event, both included."""

    step_s: float = 30.0
    warmup_s: float = 1200.0

    @property
    def step_us(self) -> int:
        return micros(self.step_s)

    def span(self, unique: DataFrame) -> Span:
        """Reads the first and last event, one row; plans made with it hold them as constants."""
        first, last = unique.agg(F.min("event_us"), F.max("event_us")).first()
        if first is None or last < first + micros(self.warmup_s):
            return Span()
        start = first + micros(self.warmup_s)
        return Span(start, (last - start) // self.step_us)

    def instants(self, spark: SparkSession, span: Span) -> DataFrame:
        """(k, at_us)"""
        return spark.range(span.steps + 1).select(F.col("id").alias("k"), (F.col("id") * self.step_us + span.start_us).alias("at_us"))

    def of_symbols(self, ticks: DataFrame, span: Span) -> DataFrame:
        """(symbol, k, at_us): the instants of every symbol, which are as many rows as the feature table has."""
        symbols = ticks.select("symbol").distinct()
        if span.steps < 0:
            return symbols.filter("false").select("symbol", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("at_us"))
        each = symbols.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(span.steps).cast("long"))))
        return each.withColumn("at_us", F.col("k") * self.step_us + span.start_us)
