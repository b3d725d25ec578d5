"""Structured Streaming over ticks.

Exact mode: each micro-batch is admitted by the per-record watermark. What the record rule needs from the past is the
greatest event time so far and the keys seen, which are written with the batch; the next batch reads those of the one
before it alone. A key is let go once its event is at or below the watermark: a redelivery would then be late anyway. (So
a redelivery that comes that late counts as late and not as duplicate; what is admitted is the same.) Batches are written
under their id, so a batch that runs again after a failure replaces what it wrote; arrival order across batches is the
source's. With `retain_s`, whole batches of admitted ticks that no window can still need are deleted.

Native mode: Spark's own watermark and deduplication. Its watermark moves between batches and not between records, and
forgets keys, so it drops no more than the exact mode and may admit a redelivery that comes very late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import FeatureSet
from ..operators.admission import as_delivered, deduplicate, is_late, with_previous_max
from ..plans.tables import Run
from ..schema import MICROS, TICK, TICK_COLUMNS, micros
from ..session import age_in_order, path_of

#: A feed at rest is read in this many batches at least, and of about this many ticks each at most.
BATCHES, BATCH_TICKS = 4, 1_000_000
#: Fixed value: what a stream keeps beyond its longest window and watermark, in seconds.
RETAIN_BEYOND_S = 60.0
_ADMITTED = "symbol string, event_us long, arrival_us long, ltp double, ltq double, seq long, batch long"
_STATE = "max_event_us long, admitted array<struct<batch:bigint,newest_us:bigint>>"
_KEYS = "symbol string, seq long, event_us long"


def default_retention_s(features: FeatureSet, watermark_s: float) -> float:
    return features.longest_us / MICROS + watermark_s + RETAIN_BEYOND_S


def as_stream(ticks: DataFrame, folder: str, batches: int = BATCHES) -> DataFrame:
    """A stream of the ticks in arrival order, a range of arrival times per batch. For feeds at rest; live ones come from a
    transport. Ranges are written in one pass, a file each, and files are given their order by age."""
    spark = ticks.sparkSession
    ticks = ticks.select(*TICK_COLUMNS)
    n = ticks.count()
    dealt = ticks.repartitionByRange(max(batches, -(-n // BATCH_TICKS)), "arrival_us") if n else ticks
    dealt.write.parquet(f"{folder}/feed")
    age_in_order(spark, f"{folder}/feed")
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")


def _written(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the batches under a folder, in order."""
    fs, path = path_of(spark, folder)
    return sorted(int(f.getPath().getName()[6:]) for f in fs.listStatus(path) if f.getPath().getName().startswith("batch=")) if fs.exists(path) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, found = path_of(spark, path)
    fs.delete(found, True)


def exact_sink(folder: str, watermark_s: float, deduplicated: bool = True, retain_s: float | None = None):
    """A foreachBatch function that appends each batch's admitted ticks to `folder`/admitted. Without `retain_s` all are kept."""
    watermark_us = micros(watermark_s)

    def admit_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in _written(spark, f"{folder}/state") if b < batch_id]
        ticks = batch.select(*TICK_COLUMNS)
        first, known, carried, held = deduplicate(ticks) if deduplicated else as_delivered(ticks), None, None, []
        if before:
            carried, held = spark.read.schema(_STATE).parquet(f"{folder}/state/batch={before[-1]}").first()
            if deduplicated:
                known = spark.read.schema(_KEYS).parquet(f"{folder}/keys/batch={before[-1]}")
                first = first.join(known, ["symbol", "seq"], "left_anti")
        carried_us = F.lit(carried).cast("long")
        ran = with_previous_max(first.select(*TICK_COLUMNS), of=ticks)
        ran = ran.withColumn("prev_max_us", F.greatest("prev_max_us", carried_us)).persist()
        try:
            put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
            admitted = ran.filter(~is_late(watermark_us)).select(*TICK_COLUMNS)
            put(admitted, "admitted")
            newest, now = ran.agg(F.max(F.when(~is_late(watermark_us), F.col("event_us"))), F.greatest(F.max("event_us"), carried_us)).first()
            held = [(b, n) for b, n in held if b != batch_id] + ([(batch_id, newest)] if newest is not None else [])
            gone = [b for b, n in held if retain_s is not None and n <= now - micros(retain_s)]
            if deduplicated:
                new = ran.select("symbol", "seq", "event_us")
                put((new if known is None else new.unionByName(known)).filter(F.col("event_us") > F.lit(now).cast("long") - watermark_us), "keys")
            put(spark.createDataFrame([(now, [x for x in held if x[0] not in gone])], _STATE).coalesce(1), "state")
            # The batch before stays, as this one may run again.
            for name in ("keys", "state"):
                for b in before[:-1]:
                    _delete(spark, f"{folder}/{name}/batch={b}")
            for b in gone:
                _delete(spark, f"{folder}/admitted/batch={b}")
        finally:
            ran.unpersist()

    return admit_batch


def admit_stream(ticks: DataFrame, folder: str, watermark_s: float, batches: int = BATCHES, deduplicated: bool = True, retain_s: float | None = None) -> DataFrame:
    """Drains the feed through the exact sink; the admitted ticks, of which those older than `retain_s` are left out."""
    spark = ticks.sparkSession
    query = (
        as_stream(ticks, folder, batches)
        .writeStream.foreachBatch(exact_sink(folder, watermark_s, deduplicated, retain_s))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = _written(spark, f"{folder}/state")
    if not written:
        return spark.createDataFrame([], TICK)
    admitted = spark.read.schema(_ADMITTED).parquet(f"{folder}/admitted").select(*TICK_COLUMNS)
    if retain_s is None:
        return admitted
    now = spark.read.schema(_STATE).parquet(f"{folder}/state/batch={written[-1]}").first()[0]
    return admitted.filter(F.col("event_us") > F.lit(now).cast("long") - micros(retain_s))


def served(run: Run, admitted: DataFrame) -> DataFrame:
    """The streaming table over ticks that a stream has admitted."""
    begun = admitted.groupBy("symbol").agg(F.min("arrival_us").alias("_begun"))
    return run._table(admitted, True).join(begun, "symbol").filter("at_us >= _begun").drop("_begun")


def native(stream: DataFrame, watermark_s: float) -> DataFrame:
    """A stream of ticks -> those that Spark's watermark and keyed deduplication let through."""
    timed = stream.withColumn("ts", F.timestamp_micros("event_us")).withWatermark("ts", f"{watermark_s:g} seconds")
    return timed.dropDuplicatesWithinWatermark(["symbol", "seq"]).drop("ts")


def native_counts(ticks: DataFrame, folder: str, watermark_s: float, batches: int = BATCHES) -> DataFrame:
    """Ticks per symbol that native mode lets through."""
    query = (
        native(as_stream(ticks, folder, batches), watermark_s)
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    passed = ticks.sparkSession.read.schema(TICK).parquet(f"{folder}/out")
    return passed.groupBy("symbol").agg(F.count("*").alias("ticks"))
