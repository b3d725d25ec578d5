"""The four feature tables over one feed.

naive          all deduplicated ticks, whenever they arrived
replay         deduplicated ticks that had arrived by the instant
streaming      those of the replay that the watermark admits, once their symbol has any
retrospective  admitted ticks, whenever they arrived
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import FeatureSet, standard_features
from ..operators.admission import DEFAULT_WATERMARK_S, admit, as_delivered, deduplicate, is_busy, is_late, with_previous_max
from ..operators.grid import Grid, Span
from ..operators.pit import feature_table
from ..schema import micros
from ..session import shared_folder


@dataclass
class Run:
    ticks: DataFrame
    watermark_s: float = DEFAULT_WATERMARK_S
    grid: Grid = field(default_factory=Grid)
    features: FeatureSet = field(default_factory=standard_features)
    panes: bool | None = None
    #: Whether a (symbol, seq) counts once; else every delivery does.
    deduplicated: bool = True

    def __post_init__(self):
        self.unique = deduplicate(self.ticks) if self.deduplicated else as_delivered(self.ticks)

    @cached_property
    def span(self) -> Span:
        """Read once for all tables of the run."""
        return self.grid.span(self.unique)

    @cached_property
    def busy(self) -> bool:
        """Whether stretches of time have to be split, read once."""
        return is_busy(self.ticks)

    @cached_property
    def ran(self) -> DataFrame:
        """Deduplicated ticks with their running maximum."""
        return with_previous_max(self.unique, of=self.ticks, busy=self.busy)

    def settle(self) -> Run:
        """Writes `ran` once, for what reads it more than once."""
        path = shared_folder(self.ticks.sparkSession, "ran")
        self.ran.write.parquet(path)
        self.ran = self.ticks.sparkSession.read.schema(self.ran.schema).parquet(path)
        self.unique = self.ran.drop("prev_max_us")
        return self

    @property
    def cells(self) -> DataFrame:
        return self.grid.of_symbols(self.ticks, self.span)

    def _table(self, ticks: DataFrame, arrived: bool) -> DataFrame:
        return feature_table(ticks, self.cells, self.span, self.features, self.grid, arrived, panes=self.panes)

    def naive(self) -> DataFrame:
        return self._table(self.unique, False)

    def replay(self) -> DataFrame:
        return self._table(self.unique, True)

    def admitted(self) -> DataFrame:
        return admit(self.unique, self.watermark_s, self.ticks, self.busy)

    def retrospective(self) -> DataFrame:
        return self._table(self.admitted(), False)

    def streaming(self) -> DataFrame:
        ticks = self.admitted()
        begun = ticks.groupBy("symbol").agg(F.min("arrival_us").alias("_begun"))
        return self._table(ticks, True).join(begun, "symbol").filter("at_us >= _begun").drop("_begun")

    def streaming_by_watermark(self, watermarks: list[float]) -> DataFrame:
        """The streaming tables of several watermarks in one plan, with `watermark_us`."""
        listed = F.explode(F.array(*(F.lit(micros(w)).cast("long") for w in watermarks)))
        ticks = self.ran.withColumn("watermark_us", listed).filter(~is_late(F.col("watermark_us"))).drop("prev_max_us")
        keys = ("watermark_us", "symbol")
        table = feature_table(ticks, self.cells.withColumn("watermark_us", listed), self.span, self.features, self.grid, True, keys, self.panes)
        begun = ticks.groupBy(*keys).agg(F.min("arrival_us").alias("_begun"))
        return table.join(begun, list(keys)).filter("at_us >= _begun").drop("_begun")
