"""As-of snapshots: versions on a date with the groups active on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import active_on, not_ended


def _day(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def versions_on(versions: DataFrame, as_of) -> DataFrame:
    """The date is a literal, so the interval is a pushed-down filter and no range join is needed."""
    return versions.where(active_on(_day(as_of)))


def groups_on(memberships: DataFrame, as_of) -> DataFrame:
    """Sorted active group ids per employee; partial sets are built before the shuffle."""
    return memberships.where(active_on(_day(as_of))).groupBy("employee_id").agg(
        F.array_sort(F.collect_set("group_id")).alias("group_ids"))


def snapshot(versions: DataFrame, memberships: DataFrame, as_of) -> DataFrame:
    """One row per employee with a version on the date; `group_ids` is never null, `attributes` is a VARIANT."""
    return (versions_on(versions, as_of).join(groups_on(memberships, as_of), "employee_id", "left")
            .withColumn("group_ids", F.coalesce("group_ids", F.array().cast("array<string>")))
            .withColumn("attributes", F.parse_json("attributes_json")).drop("attributes_json"))


def overrides_for(overrides: DataFrame, as_of) -> DataFrame:
    """Overrides that are not revoked and not ended; future ones stay for scheduling."""
    return overrides.where(~F.col("revoked") & not_ended(_day(as_of)))


def with_proposed_facts(snap: DataFrame, employee_id, facts: dict, attributes_json: str | None = None) -> DataFrame:
    """Overlay proposed facts on one employee's snapshot row."""
    mine = F.col("employee_id") == F.lit(employee_id)
    out = snap.withColumns({k: F.when(mine, F.lit(v).cast(snap.schema[k].dataType)).otherwise(F.col(k)) for k, v in facts.items()})
    if attributes_json is not None:
        out = out.withColumn("attributes", F.when(mine, F.parse_json(F.lit(attributes_json))).otherwise(F.col("attributes")))
    return out


def rules_on(rule_versions: DataFrame, policy_versions: DataFrame, as_of) -> DataFrame:
    """Published rules that have not ended, future ones included, with `policy_enabled` as of the date.

    The policy's version of the date is joined from the left: without one the
    policy is not enabled.
    """
    day = _day(as_of)
    own = policy_versions.where(active_on(day)).select("company_id", "policy_id", F.col("enabled").alias("policy_enabled"))
    rules = rule_versions.where((F.col("status") == "PUBLISHED") & not_ended(day))
    return rules.join(own, ["company_id", "policy_id"], "left").withColumn("policy_enabled", F.coalesce("policy_enabled", F.lit(False)))
