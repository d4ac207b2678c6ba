"""Import of raw personnel rows: fetch, validate, normalise, page to an exact target, keep provenance."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import iso_date, required_text, usable_name

#: Column, reason and longest value of the required texts, in the order in which they are checked.
REQUIRED = (
    ("source_row_id", ":id", "missing_source_row_id", 200), ("fiscal_year", "fiscal_year", "invalid_fiscal_year", 4),
    ("department", "agency_name", "missing_agency", 200), ("hire_date", "agency_start_date", "invalid_agency_start_date", None),
    ("location", "work_location_borough", "missing_work_location_borough", 200),
    ("job_title", "title_description", "missing_title_description", 500), ("pay_basis", "pay_basis", "missing_pay_basis", 200),
    ("employment_status", "leave_status_as_of_june_30", "missing_leave_status", 200),
    ("payroll_number", "payroll_number", "missing_payroll_number", 100))
NUMBERS = (("base_salary", "base_salary"), ("regular_hours", "regular_hours"), ("regular_gross_paid", "regular_gross_paid"),
           ("ot_hours", "overtime_hours"), ("total_ot_paid", "overtime_paid"), ("total_other_pay", "other_pay"))


def fetch_rows(url: str, attempts: int = 4, wait: Callable[[float], None] = time.sleep,
               open_url=urllib.request.urlopen) -> list[dict]:
    """GET an array of JSON objects; network errors, 429 and 5xx are retried with growing delays."""
    for n in range(1, attempts + 1):
        delay = 0.25 * 2 ** (n - 1)
        try:
            with open_url(url, timeout=60) as reply:
                rows = json.loads(reply.read())
            if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                raise ValueError("expected an array of objects")
            return rows
        except urllib.error.HTTPError as error:
            if n == attempts or not (error.code == 429 or error.code >= 500):
                raise
            after = error.headers.get("Retry-After") if error.headers else None
            delay = min(10.0, float(after)) if after and after.isdigit() else delay
        except urllib.error.URLError:
            if n == attempts:
                raise
        wait(delay)
    raise RuntimeError("unreachable")


def land(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Fetched rows as a frame of strings."""
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows],
                                 ", ".join(f"`{n}` string" for n in names))


def latest_year(raw: DataFrame) -> Column | str | None:
    """The newest fiscal year, which must be four digits."""
    year = raw.agg(F.max("fiscal_year")).first()[0]
    if year is None or not (len(year) == 4 and year.isdigit()):
        raise ValueError("the source has no valid fiscal year")
    return year


def normalise(raw: DataFrame) -> DataFrame:
    """Every raw row with its first reject reason (null if usable) and its normalised columns."""
    out, reason = {}, F.lit(None).cast("string")
    for name, source, fault, most in reversed(REQUIRED):
        value = iso_date(F.col(f"`{source}`")) if most is None else required_text(F.col(f"`{source}`"), most)
        if name == "fiscal_year":
            value = F.when(value.rlike(r"^\d{4}$"), value)
        out[name] = value
        reason = F.when(value.isNull(), fault).otherwise(reason)
    identity = F.sha2(F.concat(F.lit("source:"), out["source_row_id"]), 256)  # the presentation strips the ids' prefix again
    first, last, middle = usable_name(F.col("first_name"), 200), usable_name(F.col("last_name"), 200), usable_name(F.col("mid_init"), 50)
    numbers = {target: F.try_to_number(F.col(source), F.lit("999999999999.9999")).cast("double") for source, target in NUMBERS if source in raw.columns}
    display = F.when(first.isNotNull() & last.isNotNull(), F.concat_ws(" ", first, middle, last)).otherwise(
        F.concat(F.lit("Record "), F.upper(F.substring(identity, 1, 12))))
    rows = raw.select(*[c.alias(n) for n, c in out.items()], *[c.alias(n) for n, c in numbers.items()],
                      first.alias("first_name"), last.alias("last_name"), middle.alias("middle_initial"),
                      F.concat(F.lit("nyc-"), F.substring(identity, 1, 40)).alias("external_id"), display.alias("display_name"),
                      reason.alias("reject_reason"))
    content = [c for c in rows.columns if c not in ("reject_reason", "display_name", "external_id")]
    return rows.withColumn("checksum", F.sha2(F.to_json(F.struct(*sorted(content))), 256))


def reject_counts(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))


def take_exactly(rows: DataFrame, target: int) -> DataFrame:
    """The first `target` usable rows in source order, one per source id; fewer are an error.

    The cut is a top-k by source id, so no task sorts the whole source.
    """
    usable = rows.where("reject_reason IS NULL")
    first = usable.groupBy("source_row_id").agg(F.min_by(F.struct(*usable.columns), "checksum").alias("r")).select("r.*")
    cut = first.orderBy("source_row_id").limit(target)
    if cut.count() != target:
        raise ValueError(f"the source holds fewer than {target} usable rows")
    return cut


def provenance(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """Counts of an import, skipped being fetched less imported, and a digest of what was imported."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("source_row_id", "checksum"))), lambda x: x["checksum"])
    totals = imported.agg(F.count("*").alias("imported"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
    fetched = rows.count()
    return totals.select(F.lit(fetched).cast("long").alias("fetched"), "imported", (F.lit(fetched) - F.col("imported")).alias("skipped"), "digest")


def backfill(target: DataFrame, names: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Update from a join, all or nothing: every target row must find exactly one source row."""
    found = target.select(key).join(names.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    if found.where("n IS NULL OR n <> 1").limit(1).count():
        raise ValueError("the backfill does not cover every row exactly once")
    return target.drop(*columns).join(names.select(key, *columns), key)


def pages(rows: DataFrame, size: int) -> DataFrame:
    """Page number of every row in source order within each source partition key."""
    return rows.withColumn("page", F.floor((F.row_number().over(
        Window.partitionBy("fiscal_year").orderBy("source_row_id")) - 1) / size).cast("int"))
