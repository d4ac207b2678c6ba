"""What-if previews: evaluate before and after a proposed change; nothing is written."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import candidates
from .reconcile import SCOPE, difference
from .resolve import judged, winners


class PreviewError(ValueError):
    pass


def outcome(snap: DataFrame, rules: list[dict], overrides: DataFrame, cardinality: dict[str, str], as_of: datetime.date) -> DataFrame:
    rules = [r for r in rules if r["category_id"] in cardinality]
    manual = overrides.where(F.col("category_id").isin(*cardinality))
    return winners(judged(candidates(snap, rules, manual, as_of), cardinality)).select(*SCOPE, "policy_id", "candidate_id")


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per scope: counts of added, removed and unchanged policies and whether one replaced another."""
    return difference(before, after).groupBy(*SCOPE).agg(
        F.count_if(F.col("state") == "ADDED").alias("added"), F.count_if(F.col("state") == "REMOVED").alias("removed"),
        F.count_if(F.col("state") == "UNCHANGED").alias("unchanged")).withColumn(
        "replaced", (F.col("added") > 0) & (F.col("removed") > 0))


def preview_facts(snap: DataFrame, proposed: DataFrame, rules, overrides, cardinality, as_of, employee_id=None) -> DataFrame:
    """`proposed` is the snapshot with proposed facts overlaid; of one employee alone if named, before anything is evaluated."""
    if employee_id is not None:
        snap, proposed, overrides = (x.where(F.col("employee_id") == F.lit(employee_id)) for x in (snap, proposed, overrides))
    return change_summary(outcome(snap, rules, overrides, cardinality, as_of), outcome(proposed, rules, overrides, cardinality, as_of))


def preview_override(snap: DataFrame, rules, overrides: DataFrame, extra: DataFrame, cardinality, as_of, employee_id=None) -> DataFrame:
    if employee_id is not None:
        snap, overrides, extra = (x.where(F.col("employee_id") == F.lit(employee_id)) for x in (snap, overrides, extra))
    return change_summary(outcome(snap, rules, overrides, cardinality, as_of),
                          outcome(snap, rules, overrides.unionByName(extra), cardinality, as_of))


def preview_rule(snap: DataFrame, rules: list[dict], proposed: dict, overrides: DataFrame, cardinality, as_of,
                 population_limit: int | None = None) -> DataFrame:
    """Replace one rule identity over the whole population; the category of a rule cannot change."""
    for r in rules:
        if r["rule_id"] == proposed["rule_id"] and r["category_id"] != proposed["category_id"]:
            raise PreviewError("a rule cannot move to another category")
    if population_limit is not None and snap.limit(population_limit + 1).count() > population_limit:
        raise PreviewError("the population is larger than the limit; previews are never sampled")
    scope = {proposed["category_id"]: cardinality[proposed["category_id"]]}
    after = [r for r in rules if r["rule_id"] != proposed["rule_id"]] + [proposed | {"policy_enabled": True}]
    changes = change_summary(outcome(snap, rules, overrides, scope, as_of), outcome(snap, after, overrides, scope, as_of))
    none = snap.select("employee_id", F.lit(proposed["category_id"]).alias("category_id"))
    return none.join(changes, SCOPE, "left").na.fill({"added": 0, "removed": 0, "unchanged": 0, "replaced": False})


def totals(changes: DataFrame) -> DataFrame:
    """The seven totals of a preview."""
    touched = (F.col("added") > 0) | (F.col("removed") > 0)
    return changes.agg(
        F.count("*").alias("population"), F.count_if(touched).alias("affected"), F.count_if(~touched).alias("unaffected"),
        F.coalesce(F.sum("added"), F.lit(0)).cast("long").alias("additions"),
        F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("removals"),
        F.count_if("replaced").alias("replacements"), F.coalesce(F.sum("unchanged"), F.lit(0)).cast("long").alias("unchanged"))


def examples(changes: DataFrame, n: int) -> DataFrame:
    return changes.where("added > 0 OR removed > 0").orderBy("employee_id", "category_id").limit(n)
