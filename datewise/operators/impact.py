"""Impact: which (employee, category) scopes an event can change. Never too few, at times too many."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import compile_rule, selector_predicate


def dependencies(spark: SparkSession, rules: list[dict], as_of: datetime.date) -> DataFrame:
    """One row per rule version and fact it reads; as many rows as rules have leaves, so it may be broadcast."""
    rows = [(r["version_id"], r["category_id"], d.type, d.key, d.operator, d.selector, d.mandatory)
            for r in rules for d in compile_rule(r["condition"], F.lit(as_of).cast("date")).dependencies]
    return spark.createDataFrame(rows, "version_id string, category_id string, type string, key string, operator string, "
                                       "selector string, mandatory boolean")


def _active(rules: list[dict], as_of: datetime.date) -> list[dict]:
    day = as_of.isoformat()
    return [r for r in rules if r["enabled"] and r["valid_from"] <= day and (not r["valid_to"] or r["valid_to"] > day)]


def employee_impact(spark: SparkSession, changes: DataFrame, rules: list[dict], categories: list[str], as_of: datetime.date) -> DataFrame:
    """`changes` has employee_id and changed_fields; no fields means every category.

    A field is a stable column name or `attributes.<key>`.
    """
    deps = dependencies(spark, _active(rules, as_of), as_of).select(
        F.when(F.col("type") == "ATTRIBUTE", F.concat(F.lit("attributes."), F.col("key"))).otherwise(F.col("key")).alias("field"),
        "category_id", "type").where("type IN ('FIELD', 'ATTRIBUTE')").select("field", "category_id").distinct()
    named = changes.select("employee_id", F.explode("changed_fields").alias("field")).join(F.broadcast(deps), "field").select(
        "employee_id", "category_id")
    every = changes.where(F.size("changed_fields") == 0).select(
        "employee_id", F.explode(F.array(*map(F.lit, categories))).alias("category_id"))
    return named.unionByName(every).distinct()


def group_impact(spark: SparkSession, changes: DataFrame, rules: list[dict], as_of: datetime.date) -> DataFrame:
    """`changes` has employee_id and group_id."""
    deps = dependencies(spark, _active(rules, as_of), as_of).where("type = 'GROUP'").select(
        F.col("key").alias("group_id"), "category_id").distinct()
    return changes.join(F.broadcast(deps), "group_id").select("employee_id", "category_id").distinct()


def population(snap: DataFrame, condition: dict, as_of: datetime.date) -> DataFrame:
    """Employees that the mandatory selectors of a condition leave; all of them if there is none."""
    rule = compile_rule(condition, F.lit(as_of).cast("date"))
    return snap.where(selector_predicate(rule.selectors)).select("employee_id")


def rule_impact(snap: DataFrame, old: dict | None, new: dict, category: str, as_of: datetime.date) -> DataFrame:
    """The populations of the old and the new version together."""
    out = population(snap, new, as_of)
    if old is not None:
        out = out.union(population(snap, old, as_of))
    return out.distinct().withColumn("category_id", F.lit(category))


def policy_impact(snap: DataFrame, assignments: DataFrame, policy_id: str, rules: list[dict], as_of: datetime.date) -> DataFrame:
    """Who holds the policy now and whom a rule of it that has not ended can match."""
    out = assignments.where(F.col("policy_id") == policy_id).select("employee_id", "category_id")
    for r in rules:
        if r["policy_id"] == policy_id and (not r["valid_to"] or r["valid_to"] > as_of.isoformat()):
            out = out.union(population(snap, r["condition"], as_of).withColumn("category_id", F.lit(r["category_id"])))
    return out.distinct()


def full_impact(snap: DataFrame, categories: list[str]) -> DataFrame:
    """Every employee in every category, without a join: the categories are exploded from a literal."""
    return snap.select("employee_id", F.explode(F.array(*map(F.lit, categories))).alias("category_id"))


def listed_impact(events: DataFrame) -> DataFrame:
    """Scopes listed by fan-out, override and temporal events (array of employee_id, category_id)."""
    return events.select(F.inline("scopes"))


def repeated_scopes(events: DataFrame) -> DataFrame:
    """Scopes that one event lists twice, which is an error."""
    return events.select("event_id", F.inline("scopes")).groupBy("event_id", "employee_id", "category_id").count().where("count > 1")
