"""Helpers that the operators of this subpackage share: tables, the shared folder and its file system."""

from __future__ import annotations

import atexit
import os
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once. Texts can be long, so batches are small.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds. The setting is the session's and is read when a job starts, so it stays changed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def pin_splits(spark: SparkSession) -> None:
    """Keep the splits of a table's files the same from one pass to the next, also if executors come or go. The setting stays changed."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def by_folder(path: str, column: str, value: int, columns: list[str] | None = None, filters: list | None = None) -> list[dict]:
    """For executors: the rows of one partition folder of a table in the shared folder; filters skip row groups."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = file_system(path)
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{base}/{column}={value}", allow_not_found=True)) if x.path.endswith(".parquet")]
    return [r for f in sorted(files) for r in pq.read_table(fs.open_input_file(f), columns=columns, filters=filters).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors see.

    Only where that setting is unset and everything runs on one machine, as in tests, a local folder serves; a cluster without it is
    an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + posixpath.join(tempfile.gettempdir(), "checkpoints")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(top)
    return posixpath.join(top, "quercus", spark.sparkContext.applicationId)


_to_clean: dict[str, SparkSession] = {}


def _clean_up() -> None:
    for path, spark in list(_to_clean.items()):
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            delete(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is left there goes when the driver ends."""
    if not _to_clean:
        atexit.register(_clean_up)
    _to_clean[shared_dir(spark)] = spark
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(uri: str):
    """pyarrow's file system for a URI or local path, and the path in it. For executors: it knows local, HDFS and object stores."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def by_rows(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """For mapInArrow: fn on each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def remainder(id_col, mod: int):
    """crc32 of the id as text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(0))
