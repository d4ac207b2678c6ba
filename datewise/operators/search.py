"""The employee list: search, filters, whitelisted sorts, pages and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_tokens_match, contains_ignoring_case

#: Sorts a caller may name; the employee id breaks ties.
SORTS = ("external_id", "location", "department", "employment_type", "hire_date")


def order_by(sort: str, descending: bool = False) -> list[Column]:
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort}")
    column = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return [column, F.asc("employee_id")]


def matching(employees: DataFrame, text: str | None = None, location: str | None = None, department: str | None = None,
             employment_type: str | None = None, manager: bool | None = None, status: str | None = None) -> DataFrame:
    """Filters that are not given are not applied, so those that are reach the scan."""
    out = employees
    if text:
        out = out.where(contains_ignoring_case(F.col("external_id"), strip_prefix(text)) | all_tokens_match(
            F.concat_ws(" ", "location", "department"), text))
    for name, value in (("location", location), ("department", department), ("employment_type", employment_type), ("is_manager", manager)):
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    if status is not None:
        out = out.where(F.try_variant_get("attributes", "$.status", "string") == F.lit(status))
    return out


def facets(employees: DataFrame) -> DataFrame:
    """Sorted distinct values of each facet, one row; null values are no facet."""
    return employees.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("location", "department", "employment_type")],
                         F.array_sort(F.collect_set(F.try_variant_get("attributes", "$.status", "string"))).alias("status"))


def last_per_employee(decisions: DataFrame, most: int) -> DataFrame:
    """Each employee's newest decisions, at most `most`; a window group limit cuts before the shuffle."""
    newest = Window.partitionBy("employee_id").orderBy(F.desc("decided_at"), F.desc("decision_id"), "category_id")
    return decisions.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= most).drop("rn")


def activity(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """employee_id, kind, ref, at: (table, kind, its reference column, its date column) put together."""
    out = None
    for table, kind, ref, at in parts:
        one = table.select("employee_id", F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref"), F.col(at).alias("at"))
        out = one if out is None else out.unionByName(one)
    return out


def strip_prefix(query: str) -> str:
    """A search for a record id finds the id without the prefix that its presentation lacks."""
    query = query.strip()
    return query[4:] if query[:4].lower() == "nyc-" else query


def page_with_counts(employees: DataFrame, related: DataFrame, sort: str, offset: int, limit: int) -> DataFrame:
    """Cut the page first, then count related rows for its employees alone; a page is small by its limit."""
    cut = employees.orderBy(*order_by(sort)).offset(offset).limit(limit)
    counts = related.join(F.broadcast(cut.select("employee_id")), "employee_id", "left_semi").groupBy("employee_id").agg(
        F.count("*").alias("related"))
    return cut.join(counts, "employee_id", "left").na.fill({"related": 0})
