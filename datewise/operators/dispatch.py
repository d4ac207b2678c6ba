"""The impact dispatcher: events of every scope become (event, employee, category) rows, or an error."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import compile_rule, selector_predicate
from .impact import _active, dependencies

# The scopes of an event.
SCOPES = ("EMPLOYEE", "GROUP", "RULE", "POLICY", "OVERRIDE", "TEMPORAL", "FANOUT", "FULL")
PAYLOAD = ("employeeId bigint, categoryIds array<string>, changedFields array<string>, groupId string, ruleVersionId string, "
           "previousRuleVersionId string, policyId string, categoryId string, scopes array<struct<employeeId:bigint,categoryId:string>>")


def populations(snap: DataFrame, rules: list[dict], as_of: datetime.date) -> DataFrame:
    """(version_id, policy_id, category_id, employee_id): whom each rule's mandatory selectors leave, in one scan of the snapshot."""
    day = F.lit(as_of).cast("date")
    entries = [F.when(selector_predicate(compile_rule(r["condition"], day).selectors), F.struct(
        *[F.lit(r[k]).alias(k) for k in ("version_id", "policy_id", "category_id")])) for r in rules]
    if not entries:
        entries = [F.lit(None).cast("struct<version_id:string,policy_id:string,category_id:string>")]
    return snap.select("employee_id", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("r")).select("r.*", "employee_id")


def analyze(events: DataFrame, snap: DataFrame, assignments: DataFrame, rules: list[dict], categories: list[str],
            as_of: datetime.date) -> tuple[DataFrame, DataFrame]:
    """(event_id, employee_id, category_id) distinct, and (event_id, error) of events that cannot be analysed.

    `events` has event_id, scope and payload (JSON). Each scope is a branch of
    one union; populations of all rules come from one scan. Rule-sized tables
    are broadcast; events meet populations by an equi-join on the rule version.
    """
    spark = events.sparkSession
    e = events.withColumn("p", F.from_json("payload", PAYLOAD))
    known = spark.createDataFrame([(r["version_id"], r["policy_id"], r["category_id"]) for r in rules], "version_id string, policy_id string, category_id string")
    versions = known.select("version_id", F.lit(True).alias("there"))
    asked = e.where("scope = 'RULE'").select("event_id", F.explode(F.array_compact(
        F.array("p.ruleVersionId", "p.previousRuleVersionId"))).alias("version_id")).join(F.broadcast(versions), "version_id", "left")
    lost_rules = asked.groupBy("event_id").agg(F.count_if(F.col("there").isNull()).alias("n")).where("n > 0").select(
        "event_id", F.lit("MISSING_RULE_VERSION").alias("error"))
    of_policy = e.where("scope = 'POLICY'").select("event_id", F.col("p.policyId").alias("policy_id"))
    owner = known.select("policy_id", "category_id").distinct()
    lost_policies = of_policy.join(F.broadcast(owner), "policy_id", "left_anti").select("event_id", F.lit("MISSING_POLICY").alias("error"))
    listed = e.where("scope = 'FANOUT'").select("event_id", F.inline("p.scopes")).select(
        "event_id", F.col("employeeId").alias("employee_id"), F.col("categoryId").alias("category_id"))
    twice = listed.groupBy("event_id", "employee_id", "category_id").agg(F.count("*").alias("n")).where("n > 1").select(
        "event_id", F.lit("DUPLICATE_SCOPES").alias("error")).distinct()
    strange = e.where(~F.col("scope").isin(*SCOPES)).select("event_id", F.lit("UNSUPPORTED_SCOPE").alias("error"))
    errors = lost_rules.unionByName(lost_policies).unionByName(twice).unionByName(strange)

    deps = dependencies(spark, _active(rules, as_of), as_of)
    fields = deps.where("type IN ('FIELD', 'ATTRIBUTE')").select(
        F.when(F.col("type") == "ATTRIBUTE", F.concat(F.lit("attributes."), "key")).otherwise(F.col("key")).alias("field"), "category_id").distinct()
    employee = e.where("scope = 'EMPLOYEE'").select("event_id", F.col("p.employeeId").alias("employee_id"), "p.categoryIds", "p.changedFields")
    named = employee.where("categoryIds IS NOT NULL").select("event_id", "employee_id", F.explode("categoryIds").alias("category_id"))
    rest = employee.where("categoryIds IS NULL")
    blind = rest.where("changedFields IS NULL OR size(changedFields) = 0").select(
        "event_id", "employee_id", F.explode(F.array(*map(F.lit, categories))).alias("category_id"))
    seen = rest.select("event_id", "employee_id", F.explode("changedFields").alias("field")).join(F.broadcast(fields), "field").drop("field")
    groups = deps.where("type = 'GROUP'").select(F.col("key").alias("group_id"), "category_id").distinct()
    grouped = e.where("scope = 'GROUP'").select("event_id", F.col("p.employeeId").alias("employee_id"), F.col("p.groupId").alias("group_id")).join(
        F.broadcast(groups), "group_id").drop("group_id")
    direct = e.where("scope IN ('OVERRIDE', 'TEMPORAL')").select("event_id", F.col("p.employeeId").alias("employee_id"), F.col("p.categoryId").alias("category_id"))
    whom = populations(snap, rules, as_of)
    by_rule = whom.join(F.broadcast(asked.select("event_id", "version_id")), "version_id").select("event_id", "employee_id", "category_id")
    open_rules = [r for r in rules if not r["valid_to"] or r["valid_to"] > as_of.isoformat()]
    policies = F.broadcast(of_policy)
    reached = populations(snap, open_rules, as_of).join(policies, "policy_id").select("event_id", "employee_id", "category_id")
    holding = assignments.join(policies, "policy_id").select("event_id", "employee_id", "category_id")
    full = e.where("scope = 'FULL'").select("event_id")
    everyone = snap.select("employee_id", F.explode(F.array(*map(F.lit, categories))).alias("category_id"), F.lit("FULL").alias("scope")).join(
        F.broadcast(full.withColumn("scope", F.lit("FULL"))), "scope").select("event_id", "employee_id", "category_id")
    out = None
    for part in (named, blind, seen, grouped, direct, listed, by_rule, reached, holding, everyone):
        part = part.select("event_id", "employee_id", "category_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct().join(errors.select("event_id").distinct(), "event_id", "left_anti"), errors
