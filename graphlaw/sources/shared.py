"""Tables in the folder that the driver and the executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that are deleted when the JVM ends, by application.
_FOLDERS: dict[str, str] = {}
_PATH = "_graphlaw_path"
#: Share of the driver's largest heap from which on its garbage is collected between tables.
HEAP_SHARE = 0.4


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and master is local (tests, one machine), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/graphlaw"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's folder; the file system deletes it at the JVM's end."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        folder = f"{shared_dir(spark)}/graphlaw/{app}"
        _, files, path = _file(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = folder
    return _FOLDERS[app]


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def settle(spark: SparkSession) -> bool:
    """Whether the driver's heap had grown past HEAP_SHARE of what it may take, and was collected.

    Between garbage collections of its own the JVM rather takes more memory than
    collects, and keeps it; after this one it gives back what it has no use for.
    Spark also drops shuffle files and broadcasts only when the frames that used them are collected.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= HEAP_SHARE * runtime.maxMemory():
        return False
    gc.collect()  # frames that only a cycle holds keep their plans in the JVM
    spark.sparkContext._jvm.System.gc()
    return True


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder; its lineage ends there. Tables go with the application, or by drop()."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    settle(spark)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, _PATH, None)
        if path:
            _, files, p = _file(df.sparkSession, path)
            files.delete(p, True)


def numbered(df: DataFrame, order: list[Column], name: str, rows_per_task: int = 500_000) -> DataFrame:
    """df as a table with a gapless long number from 0 in the given order (no ties).

    Rows are dealt into ranges, numbered there, and moved on by the sizes of the
    ranges before: one row a range is gathered, no more.
    """
    parts = int(max(1, df.count() // rows_per_task))
    placed = written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    ahead = F.sum("count").over(Window.orderBy("__range")) - F.col("count")
    offsets = placed.groupBy("__range").count().select("__range", ahead.alias("__from"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = placed.withColumn("__nth", own).join(offsets, "__range")
    out = written(out.withColumn(name, (F.col("__from") + F.col("__nth") - 1).cast("long")).select(*df.columns, name), "numbers")
    drop(placed)
    return out
