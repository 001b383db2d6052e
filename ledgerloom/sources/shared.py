"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a local Spark (tests) gets a folder of our own; a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Scratch:
    """Intermediate tables of one operator, in one folder of the shared one; all go when the session ends.

    ``write`` cuts lineage and survives lost executors; ``drop`` deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._tables: dict[int, tuple[DataFrame, str]] = {}
        folder, files = self._hadoop(self.path)
        files.deleteOnExit(folder)

    def _hadoop(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back; functions over Arrow in it get ``batch`` rows at a time.

        Shuffle files of the query go as soon as it ends: its result is written, so nothing reads them again.
        """
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        with _set(self.spark, {_FREE_SHUFFLES: "true"} | ({_BATCH: str(batch)} if batch else {})):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            folder, files = self._hadoop(self._tables.pop(id(df))[1])
            files.delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back; it stays for the session."""
    return Scratch(df.sparkSession, name).write(df, name)
