"""Local sessions and the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []
_MADE: list[str] = []


def local_session(name: str = "tidemark", cores: str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of this process's own, which only a local master can share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _OWN[0]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one; `clean` deletes it."""
    _MADE.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> int:
    """Deletes the folders that this process has made so far, and so the tables that earlier results read; their number."""
    made, _MADE[:] = list(_MADE), []
    for path in made:
        fs, found = path_of(spark, path)
        fs.delete(found, True)
    return len(made)


def path_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def age_in_order(spark: SparkSession, path: str) -> None:
    """Gives a folder's Parquet files times in the order of their names, so that a stream reads them in that order."""
    fs, folder = path_of(spark, path)
    files = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")), key=lambda f: (f.getModificationTime() // 3_600_000, f.getPath().getName()))
    newest = max((f.getModificationTime() for f in files), default=0)
    for i, f in enumerate(files):
        fs.setTimes(f.getPath(), newest - (len(files) - i) * 1000, -1)
