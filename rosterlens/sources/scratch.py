"""Intermediate tables that cut lineage and survive the loss of executors.

A run keeps its tables in a folder of its own (:class:`Scratch`). What only later steps of the
run read is deleted with :meth:`Scratch.drop` or when the run is closed; whatever a session leaves
behind goes when the session ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="rosterlens-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def _on(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_folder(spark: SparkSession, path: str) -> None:
    files, where = _on(spark, path)
    files.delete(where, True)


def session_folder(spark: SparkSession) -> str:
    """Folder of this session's tables; deleted when the session's JVM ends."""
    path = f"{scratch_root(spark)}/rosterlens/{spark.sparkContext.applicationId}"
    files, where = _on(spark, path)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go when each ends: nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write_and_read(df: DataFrame, path: str, *partitioned_by: str) -> DataFrame:
    spark = df.sparkSession
    with _shuffles_dropped(spark):
        df.write.partitionBy(*partitioned_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the session's folder and read it back.

    Unlike a row checkpoint the copy is columnar, so later readers fetch only
    the columns they use. It lives as long as the session.
    """
    return write_and_read(df, f"{session_folder(df.sparkSession)}/{uuid.uuid4().hex}")


class Scratch:
    """Tables of one run, in a folder that goes when the run is closed.

    ``with Scratch(spark) as scratch`` deletes the folder at the end, also after an error; what
    the caller returns must be a table written elsewhere (:func:`materialise`).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{session_folder(spark)}/run-{uuid.uuid4().hex}"
        self._kept: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, *partitioned_by: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        table = write_and_read(df, path, *partitioned_by)
        self._kept[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            _, path = self._kept.pop(id(table))
            delete_folder(self.spark, path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*(t for t, _ in list(self._kept.values()) if not any(t is x for x in tables)))

    def close(self) -> None:
        self._kept.clear()
        delete_folder(self.spark, self.folder)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *error) -> None:
        self.close()
