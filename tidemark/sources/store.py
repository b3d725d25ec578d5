"""Feature stores: one JSON object per line, or Parquet partitioned by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.features import FeatureSet


def feature_schema(features: FeatureSet) -> T.StructType:
    return T.StructType(
        [T.StructField("symbol", T.StringType(), False), T.StructField("at_us", T.LongType(), False), *(T.StructField(n, T.DoubleType(), True) for n in features.names)]
    )


def write_lines(rows: DataFrame, path: str) -> None:
    """Nulls are written, so that absence can be told from a missing feature. Lines end in a line feed."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").option("lineSep", "\n").json(path)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_columns(rows: DataFrame, path: str) -> None:
    rows.repartition("symbol").sortWithinPartitions("symbol", "at_us").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_columns(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Filters on symbol skip whole folders; those on at_us reach the scan."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
