"""Events and jobs as tables: dedupe, visibility, claim order, retries, fan-out and timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds

#: Scopes of one fan-out partition.
FAN_OUT = 500


def deduplicate(events: DataFrame) -> DataFrame:
    """The first event of each (company, dedupe key) by id; events without a key all stay."""
    first = events.where("dedupe_key IS NOT NULL").groupBy("company_id", "dedupe_key").agg(
        F.min_by(F.struct(*events.columns), "event_id").alias("e")).select("e.*")
    return first.unionByName(events.where("dedupe_key IS NULL"))


def visible(events: DataFrame, now: Column) -> DataFrame:
    return events.where(F.col("available_at") <= now)


def claim_order(jobs: DataFrame, evaluation_tenants: DataFrame | None = None) -> DataFrame:
    """Pending jobs with attempts left and their place in their tenant's queue; evaluation tenants are left out."""
    ready = jobs.where("status = 'PENDING' AND attempts < max_attempts")
    if evaluation_tenants is not None:
        ready = ready.join(evaluation_tenants, "company_id", "left_anti")
    return ready.withColumn("place", F.row_number().over(
        Window.partitionBy("company_id").orderBy(F.desc("priority"), "created_at", "job_id")))


def after_failure(jobs: DataFrame, now: Column) -> DataFrame:
    """State after a failed attempt, a lost worker's last one included: retried later or DEAD."""
    return jobs.withColumns({
        "status": F.when(F.col("attempts") >= F.col("max_attempts"), "DEAD").otherwise("PENDING"),
        "available_at": F.when(F.col("attempts") >= F.col("max_attempts"), F.col("available_at")).otherwise(
            F.timestamp_add("SECOND", backoff_seconds(F.col("attempts")), now)),
    })


def fan_out(scopes: DataFrame, size: int = FAN_OUT) -> DataFrame:
    """Children of each job with at most `size` scopes in scope order; one window per job."""
    own = Window.partitionBy("job_id").orderBy("employee_id", "category_id")
    placed = scopes.withColumn("partition_index", F.floor((F.row_number().over(own) - 1) / size).cast("int"))
    sizes = placed.groupBy("job_id", "partition_index").agg(F.count("*").alias("scopes"))
    return sizes.withColumn("partition_count", F.count("*").over(Window.partitionBy("job_id")).cast("int"))


def parent_state(children: DataFrame) -> DataFrame:
    """A parent waits for its children, succeeds with all of them, and is dead with any."""
    return children.groupBy("parent_id").agg(
        F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"), F.count_if(F.col("status") == "DEAD").alias("dead"),
        F.count("*").alias("children")).withColumn(
        "status", F.when(F.col("dead") > 0, "DEAD").when(F.col("succeeded") == F.col("children"), "SUCCEEDED").otherwise("WAITING"))


def due(scheduled: DataFrame, today: Column) -> DataFrame:
    """One temporal event per scope with an unprocessed date that has come, deduplicated per day."""
    return scheduled.where((F.col("date") <= today) & ~F.col("processed")).groupBy("employee_id", "category_id").agg(
        F.count("*").alias("fired"), F.min("date").alias("first_date")).withColumn(
        "dedupe_key", F.concat_ws(":", F.lit("temporal"), "employee_id", "category_id", today.cast("string")))


def backdated(events: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): nothing may take effect before today."""
    late = F.coalesce(F.col("effective_from") < today, F.lit(False))
    return events.where(~late), events.where(late).withColumn("error", F.lit("BACKDATED_MUTATION"))
