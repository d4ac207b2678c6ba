"""Resolution: candidates of a scope become winners, with a reason for every loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The reasons of a loss.
EXCLUDED = "Manual exclusion controlled this policy"
VETOED = "Policy was vetoed by a higher-precedence manual exclusion"
DUPLICATE = "Duplicate proposal for the same policy had lower precedence"
MANUAL_WON = "Another policy won because manual assignments outrank rule proposals"
PRIORITY_WON = "Another policy won because it had higher priority"
SPECIFICITY_WON = "Another policy won because its rule was more specific"
TIE_BREAK = "Another policy won by the stable candidate identifier tie-break"

SCOPE = ["employee_id", "category_id"]


def precedence() -> list[Column]:
    """Manual before rule, then priority, specificity, candidate and policy id; ids are binary-ordered."""
    return [(F.col("source") == "MANUAL").desc(), F.desc("priority"), F.desc("specificity"), F.asc("candidate_id"), F.asc("policy_id")]


def judged(candidates: DataFrame, cardinality: dict[str, str]) -> DataFrame:
    """Every candidate with `won`, `reason_lost` and `won_by`.

    Two windows over one partitioning by scope: the second reuses the shuffle of
    the first, since both partition on the scope's columns.
    """
    single = F.lit(False)
    for category, kind in cardinality.items():
        single = F.when(F.col("category_id") == category, F.lit(kind == "SINGLE")).otherwise(single)
    spread = candidates.repartition(*[F.col(c) for c in SCOPE])
    policy = Window.partitionBy(*SCOPE, "policy_id").orderBy(*precedence())
    head = F.struct("candidate_id", "source", "priority", "specificity", "action")
    held = spread.withColumns({"place": F.row_number().over(policy), "control": F.first(head).over(policy)})
    eligible = (F.col("place") == 1) & (F.col("action") == "ASSIGN")
    scope = Window.partitionBy(*SCOPE).orderBy(F.when(eligible, 0).otherwise(1), *precedence())
    ranked = held.withColumns({"eligible": eligible, "rank": F.row_number().over(scope), "top": F.first(head).over(scope)})
    won = F.col("eligible") & (~single | (F.col("rank") == 1))
    lost = (
        F.when(won, None)
        .when((F.col("place") == 1) & (F.col("action") == "EXCLUDE"), EXCLUDED)
        .when(F.col("control.action") == "EXCLUDE", VETOED)
        .when(F.col("place") > 1, DUPLICATE)
        .when(F.col("source") != F.col("top.source"), MANUAL_WON)
        .when(F.col("priority") != F.col("top.priority"), PRIORITY_WON)
        .when(F.col("specificity") != F.col("top.specificity"), SPECIFICITY_WON)
        .otherwise(TIE_BREAK))
    by = F.when(won | ((F.col("place") == 1) & (F.col("action") == "EXCLUDE")), None).when(
        F.col("place") > 1, F.col("control.candidate_id")).otherwise(F.col("top.candidate_id"))
    return ranked.select(*candidates.columns, won.alias("won"), lost.alias("reason_lost"), by.alias("won_by"))


def winners(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.where("won")


def rejected(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.where("NOT won")


def decisions(judged_rows: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Evidence per scope: winners and losers as arrays, ordered by precedence-independent ids.

    Every one of `scopes` gets a row, those without any candidate one with empty
    arrays; without `scopes`, only scopes with candidates do.
    """
    own = [c for c in judged_rows.columns if c not in (*SCOPE, "won")]
    row = F.struct("candidate_id", *[c for c in own if c != "candidate_id"])
    found = judged_rows.groupBy(*SCOPE).agg(
        F.array_sort(F.collect_list(F.when(F.col("won"), row))).alias("winners"),
        F.array_sort(F.collect_list(F.when(~F.col("won"), row))).alias("rejected"))
    if scopes is None:
        return found
    empty = F.array().cast(found.schema["winners"].dataType)
    return scopes.select(*SCOPE).join(found, SCOPE, "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("winners", "rejected")})


class ResolutionError(ValueError):
    pass


def resolve_category(candidates: DataFrame, category_id: str, cardinality: str) -> DataFrame:
    """`judged` for one category; a candidate of another is an error, as nothing may be judged across categories."""
    other = candidates.where(F.col("category_id") != category_id).select("category_id").limit(1).collect()
    if other:
        raise ResolutionError(f"candidates of {other[0][0]} among those of {category_id}")
    return judged(candidates, {category_id: cardinality})


def mixed_categories(candidates: DataFrame) -> DataFrame:
    """Candidates under one id in several categories, which resolution does not allow."""
    return candidates.groupBy("candidate_id").agg(F.count_distinct("category_id").alias("categories")).where("categories > 1")
