"""The feature specification and its compilation to columns.

A feature aggregates one source over a trailing window (T - w, T], or over all ticks up to T where it has none; a
derived feature is an expression over features. Aggregates are decomposable: each compiles to partial columns that are
merged by sums, maxima and minima, so one specification serves panes, range joins and late corrections alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MEASURE_STEPS, micros, steps

AGGREGATIONS = ("mean", "sum", "count", "last", "max", "min")


@dataclass(frozen=True)
class Window:
    """The trailing window (end - seconds, end]."""

    seconds: float

    @property
    def us(self) -> int:
        return micros(self.seconds)

    def contains(self, event_us: Column, end_us: Column) -> Column:
        return (event_us > end_us - self.us) & (event_us <= end_us)


@dataclass(frozen=True)
class Feature:
    name: str
    source: str
    aggregation: str
    window: Window | None = None
    empty: float | None = None
    text: str = ""

    def __post_init__(self):
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation: {self.aggregation!r}")
        if (self.window is None) != (self.aggregation == "last"):
            raise ValueError(f"{self.name}: last is as of an instant; the other aggregations need a window")


@dataclass(frozen=True)
class Derived:
    name: str
    inputs: tuple[str, ...]
    build: Callable[..., Column]
    text: str = ""


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null if either side is null or the denominator is zero."""
    return F.try_divide(numerator, denominator)


@dataclass(frozen=True)
class FeatureSet:
    features: tuple[Feature, ...]
    derived: tuple[Derived, ...] = ()

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features] + [d.name for d in self.derived]

    @property
    def windows(self) -> list[Window]:
        return sorted({f.window for f in self.features if f.window}, key=lambda w: w.seconds)

    @property
    def longest_us(self) -> int:
        return max((w.us for w in self.windows), default=0)

    @property
    def sources(self) -> list[str]:
        return sorted({f.source for f in self.features})

    def only(self, *names: str) -> FeatureSet:
        """Those features, and the derived ones whose inputs are all there."""
        kept = tuple(f for f in self.features if f.name in names)
        return replace(self, features=kept, derived=tuple(d for d in self.derived if d.name in names and set(d.inputs) <= {f.name for f in kept}))

    def partials(self) -> list[tuple[str, str, str, Window | None]]:
        """(column, source, sum | count | max | min, window) that the windowed features need."""
        need = {"mean": ("sum", "count"), "sum": ("sum", "count"), "count": ("count",), "max": ("max",), "min": ("min",)}
        found = {(f.source, kind, f.window) for f in self.features if f.window for kind in need[f.aggregation]}
        return sorted(((f"_{s}_{k}_{w.us}", s, k, w) for s, k, w in found), key=lambda x: x[0])

    def finish(self, table: DataFrame, last: dict[str, str] | None = None) -> DataFrame:
        """Partial columns -> features: empty values, then derived ones in order, each seeing those before it."""
        last = last or {}
        for f in self.features:
            table = table.withColumn(f.name, self._value(f, last))
        return self.derive(table)

    def _value(self, f: Feature, last: dict[str, str]) -> Column:
        if f.window is None:
            value = F.col(last[f.source])
        else:
            part = lambda kind: F.col(f"_{f.source}_{kind}_{f.window.us}")
            if f.aggregation == "mean":
                value = F.try_divide(part("sum").cast("double"), part("count").cast("double") * MEASURE_STEPS)
            elif f.aggregation == "sum":
                value = F.when(part("count") > 0, part("sum").cast("double") / MEASURE_STEPS)
            elif f.aggregation == "count":
                value = F.when(part("count") > 0, part("count").cast("double"))
            else:
                value = part(f.aggregation)
        return value if f.empty is None else F.coalesce(value, F.lit(f.empty))

    def derive(self, table: DataFrame) -> DataFrame:
        for d in self.derived:
            there = set(table.columns)
            table = table.withColumn(d.name, d.build(*(F.col(n) if n in there else F.lit(None).cast("double") for n in d.inputs)))
        return table

    def empty_row(self, spark) -> DataFrame:
        """The features of an instant without any tick."""
        row = spark.range(1).select(*(F.lit(f.empty).cast("double").alias(f.name) for f in self.features))
        return self.derive(row)

    def describe(self) -> str:
        lines = [f"{'feature':<16} {'source':<6} {'aggregate':<9} {'window':>9} {'empty':>6}"]
        for f in self.features:
            window = f"{f.window.seconds:g} s" if f.window else "as of"
            lines.append(f"{f.name:<16} {f.source:<6} {f.aggregation:<9} {window:>9} {'null' if f.empty is None else f.empty:>6}  {f.text}")
        lines += [f"{d.name:<16} derived from {', '.join(d.inputs)}  {d.text}" for d in self.derived]
        lines.append(f"longest window: {self.longest_us / 1e6:g} s")
        return "\n".join(lines)


def partial_values(source: str) -> dict[str, Column]:
    """Per tick, what each partial kind merges."""
    value = F.col(source)
    return {"sum": steps(value), "count": F.when(value.isNotNull(), F.lit(1).cast("long")), "max": value, "min": value}


MERGE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def standard_features(unit: float = 1.0) -> FeatureSet:
    """The twelve features; `unit` stretches the windows (60: minutes become hours)."""
    # Names, sources, aggregates, window lengths in seconds, empty values.
    w2, w5, w20 = (Window(s * unit) for s in (120, 300, 1200))
    return FeatureSet(
        (
            Feature("ltq_avg_2m", "ltq", "mean", w2, None, "mean size, short"),
            Feature("ltq_avg_5m", "ltq", "mean", w5, None, "mean size, middle"),
            Feature("ltq_avg_20m", "ltq", "mean", w20, None, "mean size, long"),
            Feature("ltq_sum_2m", "ltq", "sum", w2, 0.0, "size traded"),
            Feature("tick_count_2m", "ltq", "count", w2, 0.0, "ticks"),
            Feature("ltp_last", "ltp", "last", None, None, "last price at or before the instant"),
            Feature("ltp_avg_5m", "ltp", "mean", w5, None, "mean price"),
            Feature("ltp_max_5m", "ltp", "max", w5, None, "highest price"),
            Feature("ltp_min_5m", "ltp", "min", w5, None, "lowest price"),
        ),
        (
            Derived("ltq_ratio_2_5", ("ltq_avg_2m", "ltq_avg_5m"), safe_ratio, "short over middle mean size"),
            Derived("ltq_spike_2_20", ("ltq_avg_2m", "ltq_avg_20m"), safe_ratio, "short over long mean size"),
            Derived("ltp_range_5m", ("ltp_max_5m", "ltp_min_5m"), lambda hi, lo: hi - lo, "price range"),
        ),
    )
