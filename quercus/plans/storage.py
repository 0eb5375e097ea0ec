"""Intermediate and stored tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a local one only where everything runs on one machine and none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + posixpath.join(tempfile.gettempdir(), "checkpoints")
    return posixpath.join(top, "engine", spark.sparkContext.applicationId)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _folders.items():
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which goes when the driver ends."""
    if not _folders:
        atexit.register(_clean)
    folder = shared_folder(spark)
    _folders[folder] = spark
    return posixpath.join(folder, f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet and read back, with its path: cuts the lineage and the plan, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def numbered(df: DataFrame, order: str | list[str], start: int, name: str = "id") -> DataFrame:
    """df with numbers from start + 1 on by `order`, a column or several: ranges are sorted apart, and only their sizes come to the driver."""
    order = [order] if isinstance(order, str) else order
    parts, _ = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    offset, at = {}, start
    for r in sorted(parts.groupBy("__part").count().collect()):
        offset[r["__part"]] = at
        at += r["count"]
    if not offset:
        return df.withColumn(name, F.lit(None).cast("long"))
    starts = F.create_map(*(F.lit(x) for kv in offset.items() for x in kv))
    w = Window.partitionBy("__part").orderBy(*order)
    return parts.withColumn(name, (starts[F.col("__part")] + F.row_number().over(w)).cast("long")).drop("__part")
