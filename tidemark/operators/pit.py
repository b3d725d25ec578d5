"""Point-in-time feature tables: trailing windows and as-of values at the instants of a grid.

Where every window is a whole number of steps, ticks are first merged into panes (symbol, step), with map-side
combination, so that a hot symbol costs one row per step from there on; windows are range frames over panes. A tick that
arrives after its own pane's end counts from the instant at which it is known: for its windows it is added to just those
instants, for the as-of value it moves to the pane in which it became known. Where a window isn't a whole number of
steps, windows come from a range join on time buckets as wide as the longest window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import MERGE, FeatureSet, partial_values
from .grid import Grid, Span


def _pane(us: Column, span: Span, step_us: int) -> Column:
    """The first step of the grid at or after a time, in whole numbers; negative before the grid."""
    after = us - F.lit(span.start_us).cast("long")
    return ((after + F.pmod(-after, F.lit(step_us))) / step_us).cast("long")


def _placed(ticks: DataFrame, span: Span, step_us: int, arrived: bool) -> DataFrame:
    """Ticks with `pane`, the step they belong to, and `known`, the step from which they are visible."""
    placed = ticks.filter(F.lit(span.steps >= 0)).withColumn("pane", _pane(F.col("event_us"), span, step_us))
    return placed.withColumn("known", F.greatest("pane", _pane(F.col("arrival_us"), span, step_us)) if arrived else F.col("pane"))


def _conditional(values: dict[str, Column], kind: str, where: Column) -> Column:
    return MERGE[kind](F.when(where, values[kind]))


def _pane_partials(placed: DataFrame, cells: DataFrame, features: FeatureSet, step_us: int, keys: list[str]) -> DataFrame:
    """Cells with the partial columns of ticks that were known in time, and `_last_<source>` of all."""
    values = {s: partial_values(s) for s in features.sources}
    on_time = F.col("known") == F.col("pane")
    kinds = sorted({(s, kind) for _, s, kind, _ in features.partials()})
    lasts = sorted({f.source for f in features.features if f.window is None})
    merged = placed.groupBy(*keys, F.col("known").alias("k")).agg(
        *(_conditional(values[s], kind, on_time).alias(f"_{s}_{kind}") for s, kind in kinds),
        *(F.max(F.struct("event_us", "seq", s)).alias(f"_at_{s}") for s in lasts),
    )
    rows = merged.unionByName(cells, allowMissingColumns=True)
    by_step = Window.partitionBy(*keys).orderBy("k")
    out = [*keys, "k", "at_us"]
    for name, s, kind, window in features.partials():
        frame = by_step.rangeBetween(1 - window.us // step_us, 0)
        out.append(MERGE[kind](F.col(f"_{s}_{kind}")).over(frame).alias(name))
    for s in lasts:
        out.append(F.max(f"_at_{s}").over(by_step.rangeBetween(Window.unboundedPreceding, 0)).getField(s).alias(f"_last_{s}"))
    return rows.select(*out).filter("at_us is not null")


def _late_partials(placed: DataFrame, features: FeatureSet, span: Span, step_us: int, keys: list[str]) -> DataFrame:
    """(keys, k) with the partial columns of ticks that became known after their pane's end."""
    values = {s: partial_values(s) for s in features.sources}
    final = F.least(F.col("pane") + features.longest_us // step_us - 1, F.lit(span.steps).cast("long"))
    late = placed.filter(F.col("known") > F.col("pane")).withColumn("_from", F.greatest("known", F.lit(0).cast("long"))).withColumn("_to", final)
    spread = late.filter("_from <= _to").withColumn("k", F.explode(F.sequence("_from", "_to")))
    inside = lambda w: F.col("k") <= F.col("pane") + w.us // step_us - 1
    return spread.groupBy(*keys, "k").agg(*(_conditional(values[s], kind, inside(w)).alias(name) for name, s, kind, w in features.partials()))


def _merged(cells: DataFrame, more: DataFrame, features: FeatureSet, keys: list[str]) -> DataFrame:
    """Partial columns of both, merged cell by cell."""
    names = {name: kind for name, _, kind, _ in features.partials()}
    both = cells.join(more.select(*keys, "k", *(F.col(n).alias(f"{n}_late") for n in names)), [*keys, "k"], "left")
    for n, kind in names.items():
        mine, other = F.col(n), F.col(f"{n}_late")
        merged = {"sum": F.coalesce(mine + other, mine, other), "max": F.greatest(mine, other), "min": F.least(mine, other)}
        both = both.withColumn(n, merged["sum" if kind == "count" else kind])
    return both.drop(*(f"{n}_late" for n in names))


def range_partials(ticks: DataFrame, cells: DataFrame, features: FeatureSet, arrived: bool, keys: list[str]) -> DataFrame:
    """(keys, k) with partial columns by a range join on time buckets; each cell looks into two buckets."""
    width = features.longest_us
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    values = {s: partial_values(s) for s in features.sources}
    looking = cells.select(*keys, "k", "at_us", F.explode(F.array(bucket("at_us"), bucket("at_us") - 1)).alias("_bucket"))
    named = ticks.withColumn("_bucket", bucket("event_us"))
    joined = looking.join(named, [*keys, "_bucket"]).filter((F.col("event_us") <= F.col("at_us")) & (F.col("event_us") > F.col("at_us") - width))
    if arrived:
        joined = joined.filter("arrival_us <= at_us")
    inside = lambda w: w.contains(F.col("event_us"), F.col("at_us"))
    return joined.groupBy(*keys, "k").agg(*(_conditional(values[s], kind, inside(w)).alias(name) for name, s, kind, w in features.partials()))


def feature_table(
    ticks: DataFrame, cells: DataFrame, span: Span, features: FeatureSet, grid: Grid, arrived: bool, keys: tuple[str, ...] = ("symbol",), panes: bool | None = None
) -> DataFrame:
    """A row per cell (keys, k, at_us) with all features over `ticks`.

    `arrived`: only ticks with arrival <= the instant are visible. `panes` forces (or forbids) panes; by default they
    are used where every window is a whole number of steps.
    """
    keys_list, step = list(keys), grid.step_us
    whole = all(w.us % step == 0 for w in features.windows)
    if panes and not whole:
        raise ValueError("panes need windows of whole steps")
    placed = _placed(ticks, span, step, arrived)
    lasts = {f.source: f"_last_{f.source}" for f in features.features if f.window is None}
    if whole if panes is None else panes:
        table = _pane_partials(placed, cells, features, step, keys_list)
        if arrived and features.windows:
            table = _merged(table, _late_partials(placed, features, span, step, keys_list), features, keys_list)
    else:
        as_of = FeatureSet(tuple(f for f in features.features if f.window is None))
        table = _pane_partials(placed, cells, as_of, step, keys_list)
        if features.windows:
            table = table.join(range_partials(ticks, cells, features, arrived, keys_list), [*keys_list, "k"], "left")
    return features.finish(table, lasts).select(*keys, "at_us", *features.names)
