"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on a single-machine session without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    # local-cluster has executors of its own, though on one machine
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_ROOT:
        keep = tempfile.TemporaryDirectory(prefix="traceloom-")
        atexit.register(keep.cleanup)
        _LOCAL_ROOT.append(f"file://{keep.name}")
    return _LOCAL_ROOT[0]


def work_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    return f"{shared_dir(spark)}/traceloom/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def store(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the table's path for ``discard``."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the whole folder goes when the driver's JVM ends, however it ends normally
    files, folder = _file_system(spark, work_folder(spark))
    files.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and lets several later jobs read one result. The table stays until
    ``release`` or the end of the application, since results that are still to be computed read it.
    """
    return store(df, tag)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the cluster has cores, if it has fewer. Meant for what is read from a table.

    For work that costs far more per row than moving the row: one small file would keep all of it on one core. Inputs
    that fill the cluster by themselves aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder; results that still read them must be finished."""
    discard(spark, work_folder(spark))
