"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints and tables.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, as
    in tests on one machine, a folder under the warehouse is set and used.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read again.

    Cuts the lineage: a lost executor costs a read, not the work before it. The
    folder goes when the application ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _system(spark, path).deleteOnExit(_path(spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; nothing may read it any more."""
    _system(df.sparkSession, df.stored_path).delete(_path(df.sparkSession, df.stored_path), True)


def _path(spark: SparkSession, path: str):  # noqa: ANN202  a Hadoop path
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):  # noqa: ANN202  the Hadoop file system of a path
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving freed memory back to the system after each batch and at the end.

    Python workers live on between tasks; what allocators keep of one stage's
    peak would else stand beside the next one's.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            release()
        release()

    return wrapped


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 2000) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of at most ``rows`` rows in the actions inside: of whole texts, 10,000 rows are large."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def tidy(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of frames made inside go when their action ends, not when the driver happens to collect its garbage.

    For frames of one action each; what is returned to others is made outside.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with glibc
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """``f`` over Arrow batches of ``df``; nothing is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None and out.num_rows:
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(frugal(run), schema)


def text_of(column: str) -> Column:
    """A string column; null stays null."""
    return F.col(f"`{column}`").cast("string")
