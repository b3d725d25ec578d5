"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import path_of, shared_folder


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Written tables of one operator run; `drop` deletes those that later steps no longer read, `tidemark.session.clean` all of a process,
    once their results are no longer needed."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        """tidy: what was shuffled for a table is deleted once it is written, not when the driver next collects its garbage."""
        self.spark, self.tidy = spark, tidy
        self.base = shared_folder(spark, name)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true" if self.tidy else before)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = path_of(self.spark, f"{self.base}/{name}")
            fs.delete(path, True)


#: Rows of text that are read from Parquet or cross to Python at once, at most: a batch of long texts has to fit into
#: an executor's and a worker's memory.
BATCH_ROWS = 500
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's batches to `rows`; lower settings stay. They have to hold when a result is computed, so they aren't raised
    again: deployments set both for the sessions that read long texts, and other queries in sessions of their own."""
    for name in _BATCHES:
        now = int(spark.conf.get(name))
        if now <= 0 or now > rows:
            spark.conf.set(name, str(rows))
