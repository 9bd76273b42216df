"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset, as in tests, a folder of the warehouse."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own among the steps, for streams and exports; it goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _system(spark, path).mkdirs(_path(spark, path))
    _system(spark, path).deleteOnExit(_path(spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, written as Parquet and read again: short plans, and a lost executor costs a read.

    The folder goes when the application ends, or by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _system(spark, path).deleteOnExit(_path(spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``written`` wrote; nothing may read it any more."""
    _system(df.sparkSession, df.written_path).delete(_path(df.sparkSession, df.written_path), True)


def _path(spark: SparkSession, path: str):  # noqa: ANN202  a Hadoop path
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):  # noqa: ANN202  the Hadoop file system of a path
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
