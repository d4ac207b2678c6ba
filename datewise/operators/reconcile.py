"""Reconciliation: minimal differences of the materialized assignments, with dated history.

State is a series of immutable generations; a new one is written beside the old
and published by name, so readers and retries never see half of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPE = ["employee_id", "category_id"]


def difference(current: DataFrame, wanted: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """employee_id, category_id, policy_id and state: ADDED, REMOVED or UNCHANGED; only scopes given are compared."""
    key = [*SCOPE, "policy_id"]
    have, want = current.select(*key), wanted.select(*key).distinct()
    if scopes is not None:
        have = have.join(scopes, SCOPE, "left_semi")
        want = want.join(scopes, SCOPE, "left_semi")
    both = have.withColumn("had", F.lit(1)).join(want.withColumn("has", F.lit(1)), key, "full")
    return both.select(*key, F.when(F.col("had").isNull(), "ADDED").when(F.col("has").isNull(), "REMOVED").otherwise("UNCHANGED").alias("state"))


def apply_difference(current: DataFrame, diff: DataFrame, decided: DataFrame, cardinality: dict[str, str], as_of: Column) -> DataFrame:
    """The next generation: unchanged rows keep their decision and start; added rows take the scope's new decision."""
    key = [*SCOPE, "policy_id"]
    kept = current.join(diff.where("state = 'REMOVED'"), key, "left_anti")
    slot = F.col("policy_id")
    for category, kind in cardinality.items():
        if kind == "SINGLE":
            slot = F.when(F.col("category_id") == category, F.col("category_id")).otherwise(slot)
    added = diff.where("state = 'ADDED'").join(decided.select(*SCOPE, "decision_id"), SCOPE, "left").select(
        *key, slot.alias("slot_key"), "decision_id", as_of.alias("effective_from"))
    return kept.select(*added.columns).unionByName(added)


def close_history(history: DataFrame, diff: DataFrame, as_of: Column) -> DataFrame:
    """Open rows of removed assignments end on the date; those that began on it or later never were."""
    key = [*SCOPE, "policy_id"]
    gone = diff.where("state = 'REMOVED'").select(*key, F.lit(True).alias("gone"))
    both = history.join(gone, key, "left")
    hit = F.coalesce("gone", F.lit(False)) & F.col("valid_to").isNull()
    kept = both.where(~(hit & (F.col("valid_from") >= as_of))).withColumn(
        "valid_to", F.when(hit, as_of).otherwise(F.col("valid_to"))).drop("gone")
    started = diff.where("state = 'ADDED'").select(*key, as_of.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return kept.select(*started.columns).unionByName(started)


def reuse_decisions(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh decisions with the id of the newest equal one (same scope, date and fingerprint), else their own."""
    key = [*SCOPE, "as_of", "fingerprint"]
    newest = known.groupBy(*key).agg(F.max_by("decision_id", F.struct("decided_at", "decision_id")).alias("old_id"))
    own = F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 32)
    return fresh.join(newest, key, "left").select(
        *key, F.coalesce("old_id", own).alias("decision_id"), F.col("old_id").isNotNull().alias("reused"))


def replace_transitions(scheduled: DataFrame, fresh: DataFrame, scopes: DataFrame, as_of: Column) -> DataFrame:
    """Unprocessed future rows of the scopes give way to the fresh ones, which are unprocessed."""
    stale = scopes.select(*SCOPE, F.lit(True).alias("stale"))
    kept = scheduled.join(stale, SCOPE, "left").where(
        ~(F.coalesce("stale", F.lit(False)) & ~F.col("processed") & (F.col("date") > as_of))).drop("stale")
    key = [*SCOPE, "source", "source_id", "date"]
    fresh = fresh.select(*key).distinct()
    return kept.join(fresh, key, "left_anti").select(*key, "processed").unionByName(fresh.withColumn("processed", F.lit(False)))


class Generations:
    """Immutable generations of a table under one folder; the newest complete one is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def newest(self) -> int | None:
        """Highest generation whose writer finished, told by its success mark."""
        root, fs = self._fs()
        if not fs.exists(root):
            return None
        done = [int(s.getPath().getName()[4:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("gen=")
                and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=None)

    def read(self) -> DataFrame | None:
        n = self.newest()
        return None if n is None else self.spark.read.parquet(f"{self.path}/gen={n}")

    def publish(self, table: DataFrame) -> int:
        n = (self.newest() or 0) + 1
        table.write.mode("overwrite").parquet(f"{self.path}/gen={n}")
        return n
