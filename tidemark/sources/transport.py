"""Transport of ticks: Kafka where its connector is on the class path, else a folder of records."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TICK_COLUMNS
from ..session import age_in_order, path_of
from .codec import from_records, to_records

FOLDER_SCHEMA = "key binary, value binary, partition int, offset long"
_CONNECTOR = "org.apache.spark.sql.kafka010.KafkaSourceProvider"


def require_kafka(spark: SparkSession) -> None:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(_CONNECTOR, False, spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception as e:
        raise RuntimeError("Kafka needs the connector: start Spark with --packages org.apache.spark:spark-sql-kafka-0-10_2.13:<Spark version>") from e


def ensure_topic(admin, topic: str, new_topic: Callable, listed: Callable, wait_s: float, pause_s: float = 0.2) -> bool:
    """Makes `topic` unless `admin` names it, then asks until each of its partitions has a leader."""
    made = topic not in set(admin.listTopics().names().get())
    if made:
        try:
            admin.createTopics(listed(new_topic())).all().get()
        except Exception as e:  # someone else was faster
            if "TopicExists" not in str(e):
                raise
            made = False
    until = time.monotonic() + wait_s
    while True:
        try:
            partitions = list(admin.describeTopics(listed(topic)).allTopicNames().get().get(topic).partitions())
            if partitions and all(p.leader() is not None and not p.leader().isEmpty() for p in partitions):
                return made
        except Exception as e:  # not yet known to every broker
            if "UnknownTopic" not in str(e):
                raise
        if time.monotonic() >= until:
            raise TimeoutError(f"no leader for every partition of {topic} within {wait_s:g} s")
        time.sleep(pause_s)


@dataclass(frozen=True)
class Kafka:
    bootstrap: str = "localhost:9092"
    topic: str = "ticks"
    # Wait for all replicas, retry, one request in flight, small linger, half a minute in all.
    producer: tuple[tuple[str, str], ...] = (
        ("kafka.acks", "all"), ("kafka.retries", "10"), ("kafka.max.in.flight.requests.per.connection", "1"), ("kafka.linger.ms", "5"),
        ("kafka.request.timeout.ms", "25000"), ("kafka.delivery.timeout.ms", "30000"),
    )

    partitions: int = 3
    replication: int = 1

    def options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.bootstrap}

    def ensure(self, spark: SparkSession, wait_s: float = 30.0) -> bool:
        """Makes the topic, whether it was made now; returns once every partition of it has a leader. Through the client that the connector brings."""
        require_kafka(spark)
        jvm = spark.sparkContext._jvm
        settings = jvm.java.util.Properties()
        settings.put("bootstrap.servers", self.bootstrap)
        admin = jvm.org.apache.kafka.clients.admin.AdminClient.create(settings)
        try:
            return ensure_topic(admin, self.topic, lambda: jvm.org.apache.kafka.clients.admin.NewTopic(self.topic, self.partitions, self.replication), jvm.java.util.Collections.singletonList, wait_s)
        finally:
            admin.close()

    def send(self, ticks: DataFrame) -> None:
        """Fails if any record could not be written."""
        require_kafka(ticks.sparkSession)
        to_records(ticks).write.format("kafka").options(**self.options(), **dict(self.producer), topic=self.topic).save()

    def read(self, spark: SparkSession) -> DataFrame:
        """All records so far, with their partition and offset."""
        require_kafka(spark)
        records = spark.read.format("kafka").options(**self.options(), subscribe=self.topic, startingOffsets="earliest", endingOffsets="latest").load()
        return from_records(records, "partition", "offset")

    def stream(self, spark: SparkSession, latest: bool = False) -> DataFrame:
        """An endless reader, or with trigger(availableNow=True) a drain; offsets are kept in the query's checkpoint."""
        require_kafka(spark)
        records = spark.readStream.format("kafka").options(**self.options(), subscribe=self.topic, startingOffsets="latest" if latest else "earliest").load()
        return from_records(records)


@dataclass(frozen=True)
class Folder:
    """The same interface over a folder: a record's partition follows from its key, its offset from arrival order."""

    path: str
    partitions: int = 3

    def ensure(self, spark: SparkSession) -> bool:
        """Makes the folder; whether it was made now."""
        fs, path = path_of(spark, self.path)
        if fs.exists(path):
            return False
        fs.mkdirs(path)
        return True

    def send(self, ticks: DataFrame) -> None:
        """Records are dealt by ranges of (partition, order), as many as their number asks for, and not by partition alone."""
        part = F.pmod(F.xxhash64("symbol"), F.lit(self.partitions)).cast("int")
        dealt = to_records(ticks.withColumn("_partition", part).withColumn("_order", F.struct("arrival_us", "seq")), "_partition", "_order")
        placed = dealt.repartitionByRange("_partition", "_order").sortWithinPartitions("_partition", "_order")
        # Offsets only have to grow within a partition; tasks hold ranges in order.
        records = placed.select("key", "value", F.col("_partition").alias("partition"), F.monotonically_increasing_id().alias("offset"))
        records.write.mode("append").parquet(self.path)
        age_in_order(ticks.sparkSession, self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return from_records(spark.read.schema(FOLDER_SCHEMA).parquet(self.path), "partition", "offset")

    def stream(self, spark: SparkSession, files_per_batch: int = 1) -> DataFrame:
        return from_records(spark.readStream.schema(FOLDER_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(self.path))


def round_trip(ticks: DataFrame, transport: Kafka | Folder) -> DataFrame:
    """What comes back of what was sent, in the transport's order."""
    spark = ticks.sparkSession
    transport.ensure(spark)
    transport.send(ticks)
    return transport.read(spark)


def lost_keys(sent: DataFrame, received: DataFrame) -> DataFrame:
    """(symbol, seq) that were sent and not received."""
    return sent.select("symbol", "seq").distinct().join(received.select("symbol", "seq"), ["symbol", "seq"], "left_anti")


def partitions_of_symbols(received: DataFrame) -> DataFrame:
    """(symbol, partitions): in how many partitions each symbol's records lie."""
    return received.groupBy("symbol").agg(F.count_distinct("partition").alias("partitions"))


def strip(received: DataFrame) -> DataFrame:
    return received.select(*TICK_COLUMNS)
