"""Half-open calendar intervals [valid_from, valid_to), an open end being null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_on(day, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    day = day if isinstance(day, Column) else F.lit(day).cast("date")
    return (F.col(valid_from) <= day) & (F.col(valid_to).isNull() | (F.col(valid_to) > day))


def not_ended(day, valid_to: str = "valid_to") -> Column:
    """Active now or later: future windows stay visible for scheduling."""
    day = day if isinstance(day, Column) else F.lit(day).cast("date")
    return F.col(valid_to).isNull() | (F.col(valid_to) > day)


def overlaps(table: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows whose interval reaches into the next one of the same key; one shuffle, no self-join."""
    w = Window.partitionBy(*key).orderBy("valid_from", order)
    following = F.lead("valid_from").over(w)
    return table.withColumn("next_from", following).where(
        F.col("next_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("next_from"))))


def append_version(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """SCD-2 append: `changes` (key, effective_from, other columns) close the open version and start the next."""
    data = [c for c in table.columns if c not in (*key, "valid_from", "valid_to", "version")]
    starts = changes.select(*key, F.col("effective_from").alias("closes_at"))
    closed = table.join(starts, key, "left").withColumn(
        "valid_to", F.when(F.col("closes_at").isNotNull() & active_on(F.col("closes_at")), F.col("closes_at")).otherwise(
            F.col("valid_to"))).drop("closes_at")
    last = table.groupBy(*key).agg(F.max("version").alias("last"))
    added = changes.join(last, key, "left").select(
        *key, *data, F.col("effective_from").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
        (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"))
    return closed.unionByName(added.select(*closed.columns))


def before_after(table: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each version with the image of the one before it."""
    previous = F.lag(F.struct(*columns)).over(Window.partitionBy(*key).orderBy(order))
    return table.withColumn("before", previous)


def changed_fields(before: Column, after: Column, names: list[str]) -> Column:
    """Names whose values differ, null equalling null, sorted."""
    return F.array_sort(F.filter(F.array(*[
        F.when(~before[n].eqNullSafe(after[n]), F.lit(n)) for n in names]), lambda x: x.isNotNull()))
