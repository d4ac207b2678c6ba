"""Sinks: import tables, tenant copies and resets, append ledgers, reports, and the schemas of the tables.

Everything is written by Spark or through its file systems, so any shared store will do.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SinkError(RuntimeError):
    pass


def _partition(table: DataFrame, company_id: str, path: str) -> None:
    """Replace one tenant's partition and no other."""
    table.withColumn("company_id", F.lit(company_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("company_id").parquet(path)


def write_import(imported: DataFrame, company_id: str, path: str) -> int:
    """Write a tenant's employees and import records, replacing only that tenant's partition; the counts must agree."""
    _partition(imported.drop("company_id"), company_id, f"{path}/employees")
    spark = imported.sparkSession
    written = spark.read.parquet(f"{path}/employees").where(F.col("company_id") == company_id)
    _partition(written.select("source_row_id", "external_id", "checksum"), company_id, f"{path}/import_records")
    n = written.count()
    if n != spark.read.parquet(f"{path}/import_records").where(F.col("company_id") == company_id).count() or n != imported.count():
        raise SinkError("the import wrote another number of rows than it was given")
    return n


def reset_and_import(tables: dict[str, DataFrame], company_id: str, path: str, names: tuple[str, ...]) -> None:
    """Make a tenant's partition of every named table what is given, and nothing where nothing is given. Safe to repeat."""
    spark = next(iter(tables.values())).sparkSession
    for name in names:
        if name in tables:
            _partition(tables[name].drop("company_id"), company_id, f"{path}/{name}")
        else:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/company_id={company_id}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def copy_tenant(path: str, spark: SparkSession, source: str, target: str) -> None:
    """Copy a tenant's facts to another tenant; the partition column prunes the read."""
    rows = spark.read.parquet(f"{path}/employees").where(F.col("company_id") == source).drop("company_id")
    _partition(rows, target, f"{path}/employees")


def append_ledger(batch: DataFrame, path: str) -> None:
    batch.write.mode("append").json(path)


def write_replay(spark: SparkSession, seed: int, executed: list[dict], path: str) -> None:
    """What is needed to run a failed plan again: its seed and the mutations executed so far."""
    _write_text(spark, json.dumps({"seed": seed, "executed": executed}, sort_keys=True), path)


def read_replay(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    record = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
    return record["seed"], record["executed"]


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(spark: SparkSession, metrics: dict, path: str) -> None:
    """A run's figures as JSON and as a Markdown table, two folders of one file each."""
    _write_text(spark, json.dumps(metrics, indent=2, sort_keys=True), f"{path}.json")
    _write_text(spark, "| metric | value |\n|---|---|\n" + "\n".join(f"| {k} | {v} |" for k, v in sorted(metrics.items())), f"{path}.md")


def benchmark_artifact(spark: SparkSession, latencies: DataFrame, column: str, path: str) -> dict:
    """Count and nearest-rank percentiles of measured latencies, reported like a run."""
    n, p = latencies.agg(F.count(column), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})")).first()
    rest = latencies.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").alias(f"p{q}") for q in (0.95, 0.99)]).first()
    metrics = {"count": n, "p50": p, "p95": rest[0], "p99": rest[1]}
    write_report(spark, metrics, path)
    return metrics


class Schemas:
    """Ordered table schemas under one folder, each applied once; one that was applied and has changed is an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _applied(self) -> dict[str, str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_schemas")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return {}
        return {r["name"]: r["digest"] for r in self.spark.read.schema("name string, digest string").json(f"{self.path}/_schemas").collect()}

    def apply(self, schemas: dict[str, str]) -> list[str]:
        """Create the empty tables that are not there yet, in order; names of those created."""
        done, made = self._applied(), []
        for name, ddl in schemas.items():
            digest = hashlib.sha256(ddl.encode()).hexdigest()
            if done.get(name, digest) != digest:
                raise SinkError(f"the schema of {name} was changed after it was applied")
            if name not in done:
                self.spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{self.path}/{name}")
                append_ledger(self.spark.createDataFrame([(name, digest)], "name string, digest string").coalesce(1), f"{self.path}/_schemas")
                made.append(name)
        return made
