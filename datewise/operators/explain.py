"""Reads of assignments: now, as of a date, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import active_on


def assignments_as_of(history: DataFrame, policy_versions: DataFrame, day) -> DataFrame:
    """Assignments of a date with the policy's name on that date."""
    names = policy_versions.where(active_on(day)).select("policy_id", "name")
    return history.where(active_on(day)).join(names, "policy_id", "left")


def name_at_start(history: DataFrame, policy_versions: DataFrame) -> DataFrame:
    """As-of join on each row's own date: the newest policy version that holds when the assignment begins.

    Equi-join on the policy, then the interval; the latest version per row is
    found by an aggregation, so no window over a policy's whole history is needed.
    """
    v = policy_versions.select("policy_id", F.col("valid_from").alias("v_from"), F.col("valid_to").alias("v_to"), "name", "version")
    hit = (F.col("v_from") <= F.col("valid_from")) & (F.col("v_to").isNull() | (F.col("v_to") > F.col("valid_from")))
    found = history.join(v, "policy_id", "left").withColumn("hit", hit)
    return found.groupBy(*history.columns).agg(F.max_by(F.when(F.col("hit"), F.col("name")), F.when(F.col("hit"), F.col("version"))).alias("policy_name"))


def latest_per(table: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key by aggregation: partial maxima are shuffled, not rows."""
    return table.groupBy(*key).agg(F.max_by(F.struct(*table.columns), F.struct(*order)).alias("row")).select("row.*")


def latest_decision_with(decisions: DataFrame, policy: Column, day: Column) -> DataFrame:
    """Newest decision up to the date whose winners hold the policy."""
    held = decisions.where((F.col("as_of") <= day) & F.exists("winners", lambda w: w["policy_id"] == policy))
    return latest_per(held, ["employee_id", "category_id"], ["decided_at", "decision_id"])


def explanation(assignments: DataFrame, judged: DataFrame, names: DataFrame) -> DataFrame:
    """For each assignment: the candidate that won, competitors by reason, and a sentence."""
    win = judged.where("won").select("employee_id", "category_id", "policy_id", "candidate_id", "source", "priority")
    others = judged.where("NOT won").groupBy("employee_id", "category_id").agg(
        F.array_sort(F.collect_list(F.struct("candidate_id", "reason_lost"))).alias("rejected"))
    out = assignments.join(win, ["employee_id", "category_id", "policy_id"]).join(
        others, ["employee_id", "category_id"], "left").join(F.broadcast(names.select("policy_id", "name")), "policy_id", "left")
    count = F.coalesce(F.size("rejected"), F.lit(0))
    return out.withColumn("competitors", F.when(F.col("rejected").isNull(), 0).otherwise(count)).withColumn("summary", F.concat(
        F.coalesce("name", "policy_id"), F.lit(" holds by "), F.when(F.col("source") == "MANUAL", "a manual control").otherwise("a rule"),
        F.lit(" at priority "), F.col("priority").cast("string"), F.lit("; rejected: "), F.col("competitors").cast("string")))


def winner_changes(decisions: DataFrame) -> DataFrame:
    """Decisions whose winners differ from the scope's previous ones, null included."""
    own = Window.partitionBy("employee_id", "category_id").orderBy("decided_at", "decision_id")
    before = decisions.withColumn("previous", F.lag("winners").over(own))
    return before.where(~F.col("winners").eqNullSafe(F.col("previous")))


def page(table: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a totally ordered collection."""
    return table.orderBy(*order).offset(offset).limit(limit)
