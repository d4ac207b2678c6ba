"""What the training-data operators share: scratch tables and corpus access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session (`spark.checkpoint.dir`).

    A private temporary folder is made only where the setting is absent and
    Spark runs in one process, as in tests; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="datewise-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


class Scratch:
    """Parquet tables in the shared folder that cut lineage.

    A table survives the loss of any executor. `put` writes and reads back,
    `drop` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bytes(self, name: str) -> int:
        """Size on disk of a table, for checks before a broadcast."""
        path = self._path(name)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int) -> DataFrame:
    """Hint a broadcast when the counted rows fit in `limit` bytes, else leave the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def slices(batches, rows: int = 1024):
    """Arrow batches cut to at most `rows` rows, so that a worker's Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
