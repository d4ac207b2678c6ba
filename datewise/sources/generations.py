"""Published generations: several tables that change together, written beside the old ones and named last.

A generation counts once its marker is there, so readers and retries never see
half of one. A batch that is replayed finds its own generation and writes none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the session's `spark.checkpoint.dir`; a temporary one only where that is unset and Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="datewise-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class State:
    """Generations of named tables under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> dict[int, str]:
        root, fs = self._hadoop(f"{self.path}/published")
        if not fs.exists(root):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return {int(n.split("-", 1)[0]): n.split("-", 1)[1] for n in names}

    def newest(self) -> int:
        return max(self._marks(), default=0)

    def published(self, batch_id: str) -> int | None:
        """The generation of a batch, if it was published."""
        return next((n for n, b in self._marks().items() if b == batch_id), None)

    def read(self, name: str, schema: str) -> DataFrame:
        n = self.newest()
        if not n:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/gen={n}/{name}")

    def stage(self, name: str, table: DataFrame) -> DataFrame:
        """Write an intermediate table of the coming generation and read it back."""
        path = f"{self.path}/work/{self.newest() + 1}/{name}"
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def publish(self, tables: dict[str, DataFrame], batch_id: str) -> int:
        n = self.newest() + 1
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.path}/gen={n}/{name}")
        mark, fs = self._hadoop(f"{self.path}/published/{n:09d}-{batch_id}")
        fs.create(mark).close()
        work, fs = self._hadoop(f"{self.path}/work/{n}")
        fs.delete(work, True)
        return n
