"""Comparison of feature tables, cell by cell and feature by feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Run
from ..schema import micros
from .admission import is_late

#: The watermarks of a sweep in seconds, those a boundary search starts from, the tolerances.
SWEEP = (0.0, 5.0, 15.0, 30.0, 45.0, 60.0, 120.0)
BOUNDARY = (0.0, 15.0, 30.0, 45.0, 60.0, 180.0)
SKEW_TOLERANCE, EXACT_TOLERANCE = 1e-9, 0.0


def compare_cells(left: DataFrame, right: DataFrame, names: list[str], tolerance: float, keys: tuple[str, ...] = ("symbol", "at_us")) -> DataFrame:
    """A row per common cell and feature: both values and whether they disagree.

    Both null agree; one null disagrees; else an absolute difference above the tolerance does.
    """
    on = list(keys)
    both = left.select(*on, F.struct(*names).alias("_l")).join(right.select(*on, F.struct(*names).alias("_r")), on)
    pairs = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.col(f"_l.{n}").alias("left"), F.col(f"_r.{n}").alias("right")) for i, n in enumerate(names)))
    cells = both.select(*on, F.explode(pairs).alias("_f")).select(*on, "_f.*")
    presence = F.col("left").isNull() != F.col("right").isNull()
    difference = F.abs(F.col("left") - F.col("right"))
    return cells.withColumn("presence_mismatch", presence).withColumn("difference", difference).withColumn(
        "disagrees", presence | F.coalesce(~(difference <= tolerance), F.lit(False))
    )


def _relative() -> Column:
    return F.when(F.col("right") != 0, F.col("difference") / F.abs("right")).otherwise(F.lit(float("inf")))


def compare(left: DataFrame, right: DataFrame, names: list[str], tolerance: float, keys: tuple[str, ...] = ("symbol", "at_us"), by: tuple[str, ...] = ()) -> DataFrame:
    """A row per feature (and per value of `by`): compared, disagreements, presence_mismatch, max_abs, max_rel, rate and
    worst_example. max_rel is the relative difference of the cell with the greatest absolute one."""
    cells = compare_cells(left, right, names, tolerance, keys)
    wrong = F.col("disagrees") & ~F.col("presence_mismatch")
    at = [k for k in keys if k not in by]
    # Of equal differences the earliest instant counts, then the least symbol.
    first = F.struct(-F.col("difference"), *sorted(at, key=lambda k: k != "at_us"))
    worst = F.min_by(F.struct(*at, "left", "right", _relative().alias("rel")), F.when(wrong, first))
    found = cells.groupBy(*by, "ordinal", "name").agg(
        F.count("*").alias("compared"),
        F.count_if("disagrees").alias("disagreements"),
        F.count_if("presence_mismatch").alias("presence_mismatch"),
        F.coalesce(F.max(F.when(wrong, F.col("difference"))), F.lit(0.0)).alias("max_abs"),
        worst.alias("worst_example"),
    )
    return found.withColumn("max_rel", F.coalesce("worst_example.rel", F.lit(0.0))).withColumn("rate", F.col("disagreements") / F.col("compared"))


def report(per_feature: DataFrame) -> DataFrame:
    """One row: features compared and disagreeing, cells, and agreement, which needs at least one compared row."""
    return per_feature.agg(
        F.count("*").alias("features"),
        F.count_if(F.col("disagreements") > 0).alias("features_disagreeing"),
        F.coalesce(F.max("compared"), F.lit(0)).alias("rows_compared"),
        F.coalesce(F.max("rate"), F.lit(0.0)).alias("worst_rate"),
    ).withColumn("agree", (F.col("features_disagreeing") == 0) & (F.col("rows_compared") > 0))


def unmatched(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("symbol", "at_us")) -> DataFrame:
    """One row: cells of one side only, and of both."""
    both = left.select(*keys, F.lit(1).alias("_l")).join(right.select(*keys, F.lit(1).alias("_r")), list(keys), "full")
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
    )


def skew(run: Run, tolerance: float = SKEW_TOLERANCE) -> DataFrame:
    """Streaming against naive: what serving sees against what training computes."""
    return compare(run.streaming(), run.naive(), run.features.names, tolerance)


def correctness(run: Run) -> DataFrame:
    """Streaming against replay, exactly."""
    return compare(run.streaming(), run.replay(), run.features.names, EXACT_TOLERANCE)


def worst_first(per_feature: DataFrame) -> DataFrame:
    return per_feature.orderBy(F.desc("rate"), "ordinal")


def _by_watermark(run: Run, other: DataFrame, watermarks: list[float], tolerance: float) -> DataFrame:
    listed = F.explode(F.array(*(F.lit(micros(w)).cast("long") for w in watermarks)))
    cells = other.withColumn("watermark_us", listed)
    return compare(run.streaming_by_watermark(watermarks), cells, run.features.names, tolerance, ("watermark_us", "symbol", "at_us"), ("watermark_us",))


def drops_by_watermark(run: Run, watermarks: list[float]) -> DataFrame:
    listed = F.explode(F.array(*(F.lit(micros(w)).cast("long") for w in watermarks)))
    each = run.ran.withColumn("watermark_us", listed)
    return each.groupBy("watermark_us").agg(F.count_if(is_late(F.col("watermark_us"))).alias("dropped"))


def watermark_sweep(run: Run, watermarks: tuple[float, ...] = SWEEP, tolerance: float = SKEW_TOLERANCE) -> DataFrame:
    """A row per watermark: what it drops, how far streaming and naive disagree, and the latency it costs. One plan
    over the run's running maximum, which is written once."""
    run.settle()
    seen = run.ticks.agg(F.count("*").alias("seen"))
    per = _by_watermark(run, run.naive(), list(watermarks), tolerance).groupBy("watermark_us").agg(
        F.count_if(F.col("disagreements") > 0).alias("bad"), F.max("rate").alias("worst")
    )
    rows = drops_by_watermark(run, list(watermarks)).join(per, "watermark_us", "left").crossJoin(seen)
    return rows.select(
        (F.col("watermark_us") / 1e6).alias("watermark_s"),
        F.col("dropped").cast("double").alias("dropped"),
        (F.col("dropped") * 100.0 / F.col("seen")).alias("dropped_pct"),
        F.coalesce(F.col("bad").cast("double"), F.lit(0.0)).alias("features_disagreeing"),
        (F.coalesce("worst", F.lit(0.0)) * 100.0).alias("worst_feature_rate_pct"),
        (F.col("watermark_us") / 1e6).alias("latency_s"),
    )


def boundary(run: Run, watermarks: list[float]) -> DataFrame:
    """A row per watermark: drops, and whether streaming and replay agree exactly on at least one row."""
    run.settle()
    per = _by_watermark(run, run.replay(), watermarks, EXACT_TOLERANCE).groupBy("watermark_us").agg(
        F.sum("disagreements").alias("disagreements"), F.max("compared").alias("rows_compared")
    )
    rows = drops_by_watermark(run, watermarks).join(per, "watermark_us", "left")
    exact = (F.coalesce("disagreements", F.lit(1)) == 0) & (F.coalesce("rows_compared", F.lit(0)) > 0)
    return rows.select((F.col("watermark_us") / 1e6).alias("watermark_s"), "dropped", exact.alias("exact"))
