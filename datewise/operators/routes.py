"""Read routes over companies, jobs and audits. Pages are totally ordered; totals are counted beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import active_on

# Job states that count as in progress.
IN_PROGRESS = ("PENDING", "RUNNING", "FAILED")


def paged(table: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the number of all rows as `total`; the total is one row, so joining it costs nothing."""
    total = table.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    cut = table.orderBy(*order).offset(offset).limit(limit).withColumn("one", F.lit(1))
    return cut.join(F.broadcast(total), "one").drop("one")


def companies(table: DataFrame, workspaces: DataFrame, evaluation_tenants: DataFrame) -> DataFrame:
    """Companies without evaluation tenants; `rank` puts product workspaces first."""
    kept = table.join(F.broadcast(evaluation_tenants.select("company_id")), "company_id", "left_anti")
    own = workspaces.select("company_id", "imported_employee_count", F.lit(True).alias("workspace"))
    return kept.join(F.broadcast(own), "company_id", "left").select(
        "company_id", "name", "created_at", "imported_employee_count",
        F.when(F.col("workspace"), "NYC_OPEN_DATA_PRODUCT").otherwise("STANDARD").alias("workspace_kind"),
        F.when(F.col("workspace"), 0).otherwise(1).alias("rank"))


def duration_ms(now: Column) -> Column:
    """Milliseconds from start to end, or to now while a job runs; null before it starts."""
    return F.timestamp_diff("MILLISECOND", F.col("started_at"), F.coalesce("finished_at", now))


def job_totals(decisions: DataFrame) -> DataFrame:
    """Per job: scopes decided and assignments selected. `winners` is an array."""
    return decisions.groupBy("job_id").agg(F.count("*").alias("affected_scopes"), F.sum(F.size("winners")).cast("long").alias("selected_assignments"))


def with_totals(jobs: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    return jobs.join(job_totals(decisions), "job_id", "left").na.fill({"affected_scopes": 0, "selected_assignments": 0}).withColumn(
        "duration_ms", duration_ms(now))


def named(jobs: DataFrame, employees: DataFrame, rule_versions: DataFrame, policies: DataFrame, groups: DataFrame) -> DataFrame:
    """The entity that a job's payload names: each key is a typed column, null where absent, and a left join of its own."""
    typed = jobs.withColumns({
        "employee_id": F.get_json_object("payload", "$.employeeId").cast("long"), "version_id": F.get_json_object("payload", "$.ruleVersionId"),
        "policy_id": F.get_json_object("payload", "$.policyId"), "group_id": F.get_json_object("payload", "$.groupId")})
    out = (typed.join(employees.select("company_id", "employee_id", "employee_name"), ["company_id", "employee_id"], "left")
           .join(rule_versions.select("company_id", "version_id", F.col("rule_id").alias("rule_key")), ["company_id", "version_id"], "left")
           .join(policies.select("company_id", "policy_id", F.col("name").alias("policy_name")), ["company_id", "policy_id"], "left")
           .join(groups.select("company_id", "group_id", F.col("name").alias("group_name")), ["company_id", "group_id"], "left"))
    return out.withColumn("entity_name", F.coalesce("employee_name", "rule_key", "policy_name", "group_name"))


def rule_changes(versions: DataFrame) -> DataFrame:
    """Each rule version against the one before it: images of both sides as JSON."""
    names = ("priority", "enabled", "valid_from", "valid_to")
    side = lambda p: F.to_json(F.struct(*[F.col(f"{p}.{n}").alias(n) for n in names]), {"ignoreNullFields": "false"})
    old = versions.select("company_id", "rule_id", (F.col("version") + 1).alias("version"), F.struct(*names).alias("old"))
    new = versions.select("company_id", "rule_id", "version", "policy_id", F.struct(*names).alias("new"))
    return new.join(old, ["company_id", "rule_id", "version"]).select(
        "company_id", "rule_id", "version", "policy_id", side("old").alias("before"), side("new").alias("after"))


def override_log(overrides: DataFrame, employees: DataFrame, policies: DataFrame) -> DataFrame:
    """Overrides with the date they last changed, newest first by it, and the names of what they touch."""
    when = F.coalesce("revoked_on", "created_on")
    return (overrides.withColumn("occurred_on", when).join(employees.select("company_id", "employee_id", "employee_name"), ["company_id", "employee_id"])
            .join(policies.select("company_id", "policy_id", F.col("name").alias("policy_name")), ["company_id", "policy_id"]))


def overview(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with a count per name; each count is an aggregation of its own table."""
    tall = None
    for name, table in counts.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        tall = one if tall is None else tall.unionByName(one)
    return tall.groupBy().pivot("name", list(counts)).agg(F.sum("n"))


def active_overrides(overrides: DataFrame, day) -> DataFrame:
    return overrides.where(~F.col("revoked") & active_on(day))


def health(spark) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))
