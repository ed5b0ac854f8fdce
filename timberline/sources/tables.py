"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from timberline.errors import TreesError

_own: dict[int, str] = {}
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all run on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise TreesError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="timberline-")
    return _own[key]


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends there, and a lost executor costs nothing but its own tasks. The tables of an application are in a folder that goes when its driver ends."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/timberline-trees-{spark.sparkContext.applicationId}"
    if own not in _marked:
        place, at = _file_system(spark, own)
        place.mkdirs(at)
        place.deleteOnExit(at)
        _marked.add(own)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discarded(table: DataFrame) -> None:
    """Deletes a settled table before that."""
    place, at = _file_system(table.sparkSession, table.settled_at)
    place.delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
