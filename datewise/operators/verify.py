"""Invariants, set comparison and measures of a run."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cardinality_violations(assignments: DataFrame, single: list[str]) -> DataFrame:
    return assignments.where(F.col("category_id").isin(*single)).groupBy("employee_id", "category_id").agg(
        F.count("*").alias("n")).where("n > 1")


def duplicates(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("employee_id", "category_id", "policy_id").agg(F.count("*").alias("n")).where("n > 1")


def tenant_leaks(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose company differs from that of what they refer to."""
    return rows.join(owners.select(key, F.col("company_id").alias("owner")), key).where("company_id <> owner")


def orphans(rows: DataFrame, owners: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(owners, key, "left_anti")


def bad_intervals(table: DataFrame, allow_empty: bool) -> DataFrame:
    end = F.col("valid_to")
    return table.where(end.isNotNull() & ((end < F.col("valid_from")) if allow_empty else (end <= F.col("valid_from"))))


def scope_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Scopes whose policy sets differ."""
    def sets(df, name):
        return df.groupBy("employee_id", "category_id").agg(F.array_sort(F.collect_set("policy_id")).alias(name))

    return sets(left, "mine").join(sets(right, "theirs"), ["employee_id", "category_id"], "full").where(
        ~F.col("mine").eqNullSafe(F.col("theirs")))


def classify(mismatches: DataFrame, processed: DataFrame) -> DataFrame:
    """A mismatch outside the processed scopes is an impact miss, inside it a divergence."""
    return mismatches.join(processed.select("employee_id", "category_id", F.lit(True).alias("seen")).distinct(),
                           ["employee_id", "category_id"], "left").withColumn(
        "kind", F.when(F.col("seen"), "DIVERGENCE").otherwise("IMPACT_MISS")).drop("seen")


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99: values that occur, never interpolated."""
    return values.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(n)
                        for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def work_avoided(runs: DataFrame) -> DataFrame:
    """Share of evaluations that impact analysis saved, by kind of change."""
    return runs.groupBy("kind").agg(F.sum("executed").alias("executed"), F.sum("full").alias("full")).withColumn(
        "avoided", F.round(1 - F.col("executed") / F.col("full"), 5))


def population_digest(rows: DataFrame, id_col: str, checksum: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(id_col, checksum))), lambda x: x[checksum])
    return rows.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


class XorShift:
    """A seeded 32-bit generator for reproducible plans."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF or 1

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        self.state = x
        return x

    def below(self, n: int) -> int:
        return self.next() % n


MUTATIONS = (
    "location", "department", "employment_type", "is_manager", "hire_date", "attribute", "attribute_remove", "membership_add",
    "membership_remove", "override_create", "override_revoke", "rule_edit", "rule_disable", "rule_enable", "policy_disable",
    "policy_enable", "date_advance")
GLOBAL = ("rule_edit", "rule_disable", "rule_enable", "policy_disable", "policy_enable", "date_advance")


def mutation_plan(seed: int, n: int, employees: int) -> list[dict]:
    """A reproducible plan over all kinds of mutation."""
    r = XorShift(seed)
    return [{"n": i, "kind": MUTATIONS[r.below(len(MUTATIONS))], "employee": r.below(employees), "value": r.below(1000)} for i in range(n)]


def batches(plan: list[dict], most: int) -> list[list[dict]]:
    """Local mutations together, at most `most`; a global one stands alone."""
    out: list[list[dict]] = []
    for m in plan:
        if m["kind"] in GLOBAL or not out or len(out[-1]) >= most or out[-1][-1]["kind"] in GLOBAL:
            out.append([m])
        else:
            out[-1].append(m)
    return out


def shuffled(rows: list, seed: int = 1) -> list:
    out = list(rows)
    random.Random(seed).shuffle(out)
    return out
