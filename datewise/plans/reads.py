"""Read catalogue, jobs, imports, universes and verification queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.temporal import active_on
from ..operators import evaluate, explain, jobs, search, universe, verify
from ..sources import fixtures as fx
from ..sources import ingest
from . import oracle as o
from .core import DAY, DIFF, SCOPES, Data, _decisions, history_close, register

SNAP = (o.snap(),)


@register("employees_search_page", o.query(
    "SELECT employee_id, external_id, location, department, hire_date FROM snap WHERE (external_id ILIKE '%urni%' OR "
    "(lower(concat_ws(' ', location, department)) LIKE '%urni%')) AND is_manager ORDER BY hire_date ASC NULLS LAST, employee_id LIMIT 20 OFFSET 5", *SNAP))
def employees_search_page(spark, d):
    found = search.matching(Data(spark, d).snap(), "urni", manager=True)
    return explain.page(found, search.order_by("hire_date"), 5, 20).select("employee_id", "external_id", "location", "department", "hire_date")


@register("employees_all_tokens", o.query(
    "SELECT employee_id FROM snap WHERE lower(concat_ws(' ', location, department)) LIKE '%nation_1%' AND lower(concat_ws(' ', location, department)) LIKE '%build%' AND attr_status = 'O'", *SNAP))
def employees_all_tokens(spark, d):
    return search.matching(Data(spark, d).snap(), " Nation_1  build ", status="O").select("employee_id")


@register("employee_facets", o.query(
    "SELECT array_to_string(list_sort(list(DISTINCT location)), ',') AS location, array_to_string(list_sort(list(DISTINCT department)), ',') AS department, "
    "array_to_string(list_sort(list(DISTINCT employment_type)), ',') AS employment_type, array_to_string(list_sort(list(DISTINCT attr_status)), ',') AS status FROM snap", *SNAP))
def employee_facets(spark, d):
    f = search.facets(Data(spark, d).snap())
    return f.select(*[F.array_join(c, ",").alias(c) for c in f.columns])


@register("employee_page_counts", o.query(
    "SELECT employee_id, coalesce(n, 0) AS related FROM (SELECT employee_id FROM snap ORDER BY location, employee_id LIMIT 50) LEFT JOIN "
    "(SELECT employee_id, count(*) AS n FROM ov GROUP BY employee_id) USING (employee_id)", *SNAP))
def employee_page_counts(spark, d):
    data = Data(spark, d)
    return search.page_with_counts(data.snap(), data.overrides, "location", 0, 50).select("employee_id", "related")


@register("employee_detail", o.query("SELECT employee_id, location, department, array_to_string(group_ids, ',') AS groups FROM snap WHERE employee_id = 7", *SNAP))
def employee_detail(spark, d):
    return Data(spark, d).snap().where("employee_id = 7").select("employee_id", "location", "department", F.array_join("group_ids", ",").alias("groups"))


ACTIVITY = ("SELECT employee_id, 'version' AS kind, CAST(version_id AS VARCHAR) AS ref, valid_from AS at FROM ev UNION ALL SELECT employee_id, 'override', CAST(id AS VARCHAR), valid_from FROM ov "
            "UNION ALL SELECT employee_id, 'assignment', policy_id, CASE WHEN state = 'ADDED' THEN DATE '1999-06-30' ELSE DATE '1998-12-31' END FROM diff "
            f"UNION ALL SELECT employee_id, 'decision', category_id || ':d0', DATE '1998-12-31' FROM {SCOPES.format('snap0')} UNION ALL SELECT employee_id, 'decision', category_id || ':d1', DATE '1999-06-30' FROM {SCOPES.format('snap')}")


def _activity(spark, d, employee_id=None) -> DataFrame:
    data = Data(spark, d)
    parts = [(data.versions, "version", "version_id", "valid_from"), (data.overrides, "override", "id", "valid_from"),
             (history_close(spark, d), "assignment", "policy_id", "valid_from"),
             (search.last_per_employee(_decisions(data).withColumn("ref", F.concat_ws(":", "category_id", "decision_id")), 100), "decision", "ref", "as_of")]
    return search.activity([(t if employee_id is None else t.where(F.col("employee_id") == employee_id), *rest) for t, *rest in parts])


@register("employee_activity", o.query(f"SELECT * FROM ({ACTIVITY}) WHERE employee_id = 7", *o.BASE, *o.BEFORE, DIFF))
def employee_activity(spark, d):
    return _activity(spark, d, 7)


@register("employee_activity_all", o.query(ACTIVITY, *o.BASE, *o.BEFORE, DIFF))
def employee_activity_all(spark, d):
    return _activity(spark, d)


@register("group_counts", o.query(f"SELECT group_id, count(*) FILTER (WHERE {o.on(o.DAY)}) AS member_count, CASE WHEN group_id = 'click' THEN 1 ELSE 0 END AS rule_count FROM gm GROUP BY group_id"))
def group_counts(spark, d):
    from ..operators.impact import dependencies

    deps = dependencies(spark, fx.RULES, DAY).where("type = 'GROUP'").groupBy(F.col("key").alias("group_id")).agg(
        F.count_distinct("version_id").cast("int").alias("rule_count"))
    members = fx.group_memberships(spark, d).groupBy("group_id").agg(F.count_if(active_on(DAY)).alias("member_count"))
    return members.join(F.broadcast(deps), "group_id", "left").na.fill({"rule_count": 0})


@register("group_members_page", o.query(
    f"SELECT group_id, employee_id, count(*) OVER () AS total FROM gm WHERE group_id = 'click' AND {o.on(o.DAY)} ORDER BY employee_id LIMIT 10"))
def group_members_page(spark, d):
    rows = fx.group_memberships(spark, d).where((F.col("group_id") == "click") & active_on(DAY)).select("group_id", "employee_id")
    total = rows.groupBy("group_id").agg(F.count("*").alias("total"))
    return explain.page(rows, [F.asc("employee_id")], 0, 10).join(F.broadcast(total), "group_id")  # one row


@register("category_counts", o.query(
    "SELECT category_id, count(DISTINCT policy_id) AS policies, count(DISTINCT employee_id) AS assignees FROM judged WHERE won GROUP BY category_id", *o.BASE))
def category_counts(spark, d):
    return Data(spark, d).assigned().groupBy("category_id").agg(
        F.count_distinct("policy_id").alias("policies"), F.count_distinct("employee_id").alias("assignees"))


@register("policy_counts", o.query(
    "SELECT p AS policy_id, coalesce(n, 0) AS assignees FROM (VALUES ('k-level'), ('k-manager'), ('k-place'), ('k-year'), ('p-default'), ('p-ended'), ('p-future'), "
    "('p-group'), ('p-machinery'), ('p-off'), ('p-tenured'), ('p-urgent')) v(p) LEFT JOIN (SELECT policy_id, count(*) AS n FROM judged WHERE won GROUP BY policy_id) ON p = policy_id", *o.BASE))
def policy_counts(spark, d):
    n = Data(spark, d).assigned().groupBy("policy_id").agg(F.count("*").alias("assignees"))
    return fx.policies(spark).select("policy_id").join(n, "policy_id", "left").na.fill({"assignees": 0})


@register("rules_search", "SELECT 'r-any' AS rule_id, 'p-default' AS policy_id, 1 AS priority UNION ALL SELECT 'r-machinery', 'p-machinery', 30 UNION ALL SELECT 'r-future', 'p-future', 90 UNION ALL SELECT 'r-ended', 'p-ended', 95")
def rules_search(spark, d):
    from ..operators.impact import dependencies

    uses = dependencies(spark, fx.RULES, DAY).where("key = 'department'").select("version_id").distinct()
    found = fx.rule_table(spark).where("category_id = 'main' AND enabled").join(uses, "version_id", "left_semi")
    return found.where(text.contains_ignoring_case(F.col("rule_id"), "R-")).orderBy("rule_id").select("rule_id", "policy_id", "priority")


@register("rule_versions", "SELECT 'r-tenured' AS rule_id, 'r-tenured-v1' AS version_id, 20 AS priority, TRUE AS enabled")
def rule_versions(spark, d):
    return fx.rule_table(spark).where("rule_id = 'r-tenured'").orderBy(F.desc("version_id")).select("rule_id", "version_id", "priority", "enabled")


@register("overrides_page", o.query("SELECT id, employee_id, policy_id, action, priority FROM ov WHERE NOT revoked ORDER BY valid_from DESC, id LIMIT 30 OFFSET 10"))
def overrides_page(spark, d):
    return explain.page(fx.manual_overrides(spark, d).where("NOT revoked"), [F.desc("valid_from"), F.asc("id")], 10, 30).select(
        "id", "employee_id", "policy_id", "action", "priority")


@register("audit_employee_changes", o.query(
    "SELECT employee_id, version, l0 AS location_before, location FROM (SELECT *, LAG(location) OVER (PARTITION BY employee_id ORDER BY version) AS l0 FROM ev) WHERE version > 1 AND l0 IS DISTINCT FROM location"))
def audit_employee_changes(spark, d):
    w = Window.partitionBy("employee_id").orderBy("version")
    return Data(spark, d).versions.withColumn("location_before", F.lag("location").over(w)).where(
        (F.col("version") > 1) & ~F.col("location").eqNullSafe(F.col("location_before"))).select("employee_id", "version", "location_before", "location")


@register("overview_counts", o.query(
    "SELECT (SELECT count(*) FROM snap) AS employees, (SELECT count(DISTINCT group_id) FROM gm) AS groups, CAST(12 AS BIGINT) AS policies, "
    f"(SELECT count(*) FROM judged WHERE won) AS assignments, (SELECT count(*) FROM ov WHERE NOT revoked AND {o.on(o.DAY)}) AS overrides", *o.BASE))
def overview_counts(spark, d):
    data = Data(spark, d)
    parts = [(data.snap(), "employees"), (data.memberships.select("group_id").distinct(), "groups"), (fx.policies(spark), "policies"),
             (data.assigned(), "assignments"), (data.overrides.where(~F.col("revoked") & active_on(DAY)), "overrides")]
    tall = None
    for df, name in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        tall = one if tall is None else tall.unionByName(one)
    return tall.groupBy().pivot("name", [n for _, n in parts]).agg(F.sum("n"))


# Jobs: one per order of the last years; the state machine's columns are derived from its key.
JOB = ("job AS (SELECT o_orderkey AS job_id, 'c' || o_custkey % 5 AS company_id, o_custkey AS employee_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'k' || o_orderkey % 97 END AS dedupe_key, "
       "CAST(o_orderkey % 3 * 10 AS INT) AS priority, CAST(o_orderkey % 7 AS INT) AS attempts, 5 AS max_attempts, CASE WHEN o_orderkey % 2 = 0 THEN 'PENDING' ELSE 'SUCCEEDED' END AS status, "
       "CAST(o_orderdate AS DATE) AS created_at FROM orders)")


def _jobs(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return fx.read(spark, d, "orders").select(
        k.alias("job_id"), k.alias("event_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("company_id"), F.col("o_custkey").alias("employee_id"),
        F.when(k % 4 != 0, F.concat(F.lit("k"), (k % 97).cast("string"))).alias("dedupe_key"), (k % 3 * 10).cast("int").alias("priority"),
        (k % 7).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), F.when(k % 2 == 0, "PENDING").otherwise("SUCCEEDED").alias("status"),
        F.col("o_orderdate").cast("date").alias("created_at"))


@register("job_dedupe", o.query("SELECT company_id, dedupe_key, min(job_id) AS job_id FROM job WHERE dedupe_key IS NOT NULL GROUP BY ALL UNION ALL SELECT company_id, dedupe_key, job_id FROM job WHERE dedupe_key IS NULL", JOB))
def job_dedupe(spark, d):
    return jobs.deduplicate(_jobs(spark, d)).select("company_id", "dedupe_key", "job_id")


@register("job_claim_order", o.query(
    "SELECT job_id, company_id, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY priority DESC, created_at, job_id) AS place FROM job WHERE status = 'PENDING' AND attempts < 5 AND company_id <> 'c4'", JOB))
def job_claim_order(spark, d):
    tenants = spark.createDataFrame([("c4",)], "company_id string")
    return jobs.claim_order(_jobs(spark, d), tenants).select("job_id", "company_id", F.col("place").cast("long").alias("place"))


@register("job_backoff_state", o.query(
    "SELECT job_id, CASE WHEN attempts >= 5 THEN 'DEAD' ELSE 'PENDING' END AS status, CASE WHEN attempts >= 5 THEN 0 ELSE CAST(least(300, pow(2, least(attempts, 8))) AS INT) END AS delay FROM job", JOB))
def job_backoff_state(spark, d):
    now = F.lit(datetime.datetime(2000, 1, 1))
    after = jobs.after_failure(_jobs(spark, d).withColumn("available_at", now), now)
    return after.select("job_id", "status", F.timestamp_diff("SECOND", now, F.col("available_at")).cast("int").alias("delay"))


@register("fanout_partitions", o.query(
    "SELECT company_id AS job_id, CAST(p AS INT) AS partition_index, count(*) AS scopes, CAST(max(max(p)) OVER (PARTITION BY company_id) + 1 AS INT) AS partition_count FROM "
    "(SELECT company_id, (ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY employee_id, job_id) - 1) // 500 AS p FROM job) GROUP BY company_id, p", JOB))
def fanout_partitions(spark, d):
    scopes = _jobs(spark, d).select(F.col("company_id").alias("job_id"), "employee_id", F.col("event_id").alias("category_id"))
    return jobs.fan_out(scopes)


@register("fanout_parent_state", o.query(
    "SELECT company_id AS parent_id, count(*) FILTER (WHERE attempts >= 5) AS dead, count(*) AS children, CASE WHEN count(*) FILTER (WHERE attempts >= 5) > 0 THEN 'DEAD' ELSE 'WAITING' END AS status FROM job GROUP BY company_id", JOB))
def fanout_parent_state(spark, d):
    children = _jobs(spark, d).select(F.col("company_id").alias("parent_id"), F.when(F.col("attempts") >= 5, "DEAD").otherwise(F.col("status")).alias("status"))
    return jobs.parent_state(children).select("parent_id", "dead", "children", "status")


@register("due_schedules", o.query("SELECT employee_id, category_id, count(*) AS fired, min(valid_to) AS first_date FROM ov WHERE NOT revoked AND valid_to <= DATE '1999-06-30' GROUP BY ALL"))
def due_schedules(spark, d):
    timers = fx.manual_overrides(spark, d).where("valid_to IS NOT NULL").select(
        "employee_id", "category_id", F.col("valid_to").alias("date"), F.col("revoked").alias("processed"))
    return jobs.due(timers, F.lit(DAY)).select("employee_id", "category_id", "fired", "first_date")


@register("backdated_quarantine", o.query("SELECT id, 'BACKDATED_MUTATION' AS error FROM ov WHERE valid_from < DATE '1999-06-30'"))
def backdated_quarantine(spark, d):
    return jobs.backdated(fx.manual_overrides(spark, d).withColumnRenamed("valid_from", "effective_from"), F.lit(DAY))[1].select("id", "error")


@register("activity_counts", o.query("SELECT company_id, status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM job GROUP BY ALL", JOB))
def activity_counts(spark, d):
    return _jobs(spark, d).groupBy("company_id", "status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


# Imports: raw personnel rows from suppliers' and customers' columns, with faults by key.
RAW = ("raw AS (SELECT CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE 'row-' || c_custkey // 2 END AS id, CASE WHEN c_custkey % 37 = 0 THEN '19x9' ELSE '2024' END AS fy, "
       "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS agency, CASE WHEN c_custkey % 29 = 0 THEN '2024-02-30' ELSE '2020-01-15T00:00:00' END AS started, "
       "CASE WHEN c_custkey % 23 = 0 THEN '' ELSE '  ' || c_name || '  x ' END AS title, c_custkey FROM customer)")
REASON = ("CASE WHEN trim(id) = '' THEN 'missing_source_row_id' WHEN fy = '19x9' THEN 'invalid_fiscal_year' WHEN agency IS NULL THEN 'missing_agency' "
          "WHEN started = '2024-02-30' THEN 'invalid_agency_start_date' WHEN title = '' THEN 'missing_title_description' END")


def _raw(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return fx.read(spark, d, "customer").select(
        F.when(k % 41 == 0, " ").otherwise(F.concat(F.lit("row-"), F.floor(k / 2).cast("string"))).alias(":id"),
        F.when(k % 37 == 0, "19x9").otherwise("2024").alias("fiscal_year"), F.when(k % 31 != 0, F.col("c_mktsegment")).alias("agency_name"),
        F.when(k % 29 == 0, "2024-02-30").otherwise("2020-01-15T00:00:00").alias("agency_start_date"),
        F.when(k % 23 == 0, "").otherwise(F.concat(F.lit("  "), "c_name", F.lit("  x "))).alias("title_description"),
        F.lit("MANHATTAN").alias("work_location_borough"), F.lit("per Annum").alias("pay_basis"), F.lit("ACTIVE").alias("leave_status_as_of_june_30"),
        k.cast("string").alias("payroll_number"), F.lit("XXX").alias("first_name"), F.lit("Lee").alias("last_name"), F.lit(None).cast("string").alias("mid_init"),
        F.col("c_acctbal").cast("string").alias("base_salary"))


@register("import_reject_reasons", o.query(f"SELECT {REASON} AS reject_reason, count(*) AS n FROM raw WHERE {REASON} IS NOT NULL GROUP BY ALL", RAW))
def import_reject_reasons(spark, d):
    return ingest.reject_counts(ingest.normalise(_raw(spark, d)))


@register("import_normalised", o.query(
    f"SELECT id AS source_row_id, c_custkey AS payroll, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS job_title, 'nyc-' || sha256('source:' || id)[1:40] AS external_id, "
    f"'Record ' || upper(sha256('source:' || id)[1:12]) AS display_name FROM raw WHERE {REASON} IS NULL", RAW))
def import_normalised(spark, d):
    return ingest.normalise(_raw(spark, d)).where("reject_reason IS NULL").select(
        "source_row_id", F.col("payroll_number").cast("long").alias("payroll"), "job_title", "external_id", "display_name")


@register("import_exact_target", o.query(f"SELECT DISTINCT id AS source_row_id FROM raw WHERE {REASON} IS NULL ORDER BY 1 LIMIT 60", RAW))
def import_exact_target(spark, d):
    return ingest.take_exactly(ingest.normalise(_raw(spark, d)), 60).select("source_row_id")


@register("import_checksum")
def import_checksum(spark, d):
    rows = ingest.normalise(_raw(spark, d))
    return ingest.provenance(rows, ingest.take_exactly(rows, 60))


@register("presentation_titles", "SELECT c_custkey AS employee_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building of NYC/HR' WHEN 'MACHINERY' THEN 'Machinery of NYC/HR' "
          "WHEN 'AUTOMOBILE' THEN 'Automobile of NYC/HR' WHEN 'FURNITURE' THEN 'Furniture of NYC/HR' WHEN 'HOUSEHOLD' THEN 'Household of NYC/HR' END AS label, "
          "'ROW' || upper(sha256(CAST(c_custkey AS VARCHAR))[1:9]) AS record FROM customer")
def presentation_titles(spark, d):
    c = fx.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("employee_id"), text.format_imported(F.concat(F.lit("** "), "c_mktsegment", F.lit(" OF NYC/HR"))).alias("label"),
                    text.record_id(F.concat(F.lit("nyc-row-"), F.sha2(F.col("c_custkey").cast("string"), 256))).alias("record"))


@register("facts_distribution", o.query("SELECT location, count(*) AS n FROM snap GROUP BY location", *SNAP))
def facts_distribution(spark, d):
    return universe.distribution(Data(spark, d).snap(), "location")


@register("combo_counts", o.query("SELECT department, employment_type, count(*) AS n FROM snap GROUP BY ALL", *SNAP))
def combo_counts(spark, d):
    return universe.distribution(Data(spark, d).snap(), "department", "employment_type")


@register("incomplete_facts", o.query("SELECT employee_id, concat_ws(',', CASE WHEN employment_type IS NULL THEN 'employment_type' END, CASE WHEN hire_date IS NULL THEN 'hire_date' END) AS missing FROM snap WHERE employment_type IS NULL OR hire_date IS NULL", *SNAP))
def incomplete_facts(spark, d):
    return universe.require_complete(Data(spark, d).snap(), ["employment_type", "hire_date"]).select("employee_id", F.array_join("missing", ",").alias("missing"))


@register("top_cohorts", o.query("SELECT employee_id, location AS group_id FROM snap WHERE location IN (SELECT location FROM snap GROUP BY location ORDER BY count(*) DESC, location LIMIT 8)", *SNAP))
def top_cohorts(spark, d):
    return universe.cohort_members(Data(spark, d).snap(), "location", 8)


@register("tenure_tiers", o.query("SELECT CASE WHEN tenure >= 3650 THEN 'veteran' WHEN tenure >= 1825 THEN 'senior' WHEN tenure >= 730 THEN 'established' WHEN tenure >= 0 THEN 'new' END AS tier, count(*) AS n FROM snap GROUP BY ALL", *SNAP))
def tenure_tiers(spark, d):
    days = F.greatest(F.lit(0), F.datediff(F.lit(DAY), F.col("hire_date")))
    return Data(spark, d).snap().groupBy(universe.tenure_tier(F.when(F.col("hire_date").isNotNull(), days)).alias("tier")).agg(F.count("*").alias("n"))


@register("role_families")
def role_families(spark, d):
    titles = fx.read(spark, d, "part").groupBy(F.col("p_name").alias("title")).agg(F.count("*").alias("n"))
    return universe.role_families(titles, ("THE", "AND"))


@register("domain_rules", o.query(
    "SELECT key, n, priority FROM (SELECT department AS key, count(*) AS n, 400 AS priority, 0 AS f FROM snap GROUP BY department UNION ALL (SELECT * FROM ("
    "SELECT department || '|' || location AS key, count(*) AS n, 360 AS priority, 1 AS f FROM snap GROUP BY department, location UNION ALL "
    "SELECT department || '|' || location || '|' || employment_type, count(*), 320, 1 FROM snap WHERE employment_type IS NOT NULL GROUP BY department, location, employment_type) "
    "ORDER BY n DESC, key LIMIT 50)) ORDER BY f, n DESC, key LIMIT 50", *SNAP))
def domain_rules(spark, d):
    return universe.domain_rules(Data(spark, d).snap(), ["department", "location", "employment_type"], 400)


@register("universe_fingerprint")
def universe_fingerprint(spark, d):
    return universe.semantic_fingerprint(domain_rules(spark, d), ["key", "n", "priority"])


@register("inv_cardinality", o.query("SELECT employee_id, category_id, count(*) AS n FROM judged WHERE won AND category_id = 'main' GROUP BY ALL HAVING count(*) > 1", *o.BASE))
def inv_cardinality(spark, d):
    return verify.cardinality_violations(Data(spark, d).assigned(), ["main"])


# The same checks over assignments in which violations are planted.
PLANTED = ("planted AS (SELECT employee_id, category_id, policy_id FROM judged WHERE won UNION ALL SELECT employee_id, category_id, 'p-extra' FROM judged WHERE won AND employee_id % 11 = 0 "
           "UNION ALL SELECT employee_id, category_id, policy_id FROM judged WHERE won AND employee_id % 13 = 0)")


def _planted(spark, d) -> DataFrame:
    a = Data(spark, d).assigned()
    return a.unionByName(a.where("employee_id % 11 = 0").withColumn("policy_id", F.lit("p-extra"))).unionByName(a.where("employee_id % 13 = 0"))


@register("inv_cardinality_planted", o.query("SELECT employee_id, category_id, count(*) AS n FROM planted WHERE category_id = 'main' GROUP BY ALL HAVING count(*) > 1", *o.BASE, PLANTED))
def inv_cardinality_planted(spark, d):
    return verify.cardinality_violations(_planted(spark, d), ["main"])


@register("inv_duplicates_planted", o.query("SELECT employee_id, category_id, policy_id, count(*) AS n FROM planted GROUP BY ALL HAVING count(*) > 1", *o.BASE, PLANTED))
def inv_duplicates_planted(spark, d):
    return verify.duplicates(_planted(spark, d))


@register("inv_bad_intervals_planted", o.query("SELECT employee_id, id FROM (SELECT *, CASE WHEN id % 7 = 0 THEN valid_from ELSE valid_to END AS ends FROM ov) WHERE ends IS NOT NULL AND ends <= valid_from"))
def inv_bad_intervals_planted(spark, d):
    rows = fx.manual_overrides(spark, d).withColumn("valid_to", F.when(F.col("id") % 7 == 0, F.col("valid_from")).otherwise(F.col("valid_to")))
    return verify.bad_intervals(rows, allow_empty=False).select("employee_id", "id")


@register("inv_orphans_planted", o.query("SELECT DISTINCT CASE WHEN employee_id % 9 = 0 THEN -employee_id - 1 ELSE employee_id END AS employee_id FROM ov WHERE employee_id % 9 = 0"))
def inv_orphans_planted(spark, d):
    data = Data(spark, d)
    rows = data.overrides.select(F.when(F.col("employee_id") % 9 == 0, -F.col("employee_id") - 1).otherwise(F.col("employee_id")).alias("employee_id")).distinct()
    return verify.orphans(rows, data.versions.select("employee_id"), ["employee_id"])


@register("inv_duplicates", o.query("SELECT employee_id, category_id, policy_id, count(*) AS n FROM judged WHERE won GROUP BY ALL HAVING count(*) > 1", *o.BASE))
def inv_duplicates(spark, d):
    return verify.duplicates(Data(spark, d).assigned())


@register("inv_tenant_leak", o.query("SELECT id FROM ov WHERE employee_id % 5 <> id % 5"))
def inv_tenant_leak(spark, d):
    data = Data(spark, d)
    owners = data.versions.select("employee_id", F.concat(F.lit("c"), (F.col("employee_id") % 5).cast("string")).alias("company_id")).distinct()
    rows = data.overrides.withColumn("company_id", F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))
    return verify.tenant_leaks(rows, owners, "employee_id").select("id")


@register("inv_bad_intervals", o.query("SELECT employee_id, group_id FROM gm WHERE valid_to IS NOT NULL AND valid_to <= valid_from"))
def inv_bad_intervals(spark, d):
    return verify.bad_intervals(fx.group_memberships(spark, d), allow_empty=False).select("employee_id", "group_id")


@register("inv_orphans", "SELECT user_id AS employee_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def inv_orphans(spark, d):
    data = Data(spark, d)
    members = fx.read(spark, d, "events").select(F.col("user_id").alias("employee_id")).distinct()
    return verify.orphans(members, data.versions.select("employee_id"), ["employee_id"])


@register("oracle_set_comparison", o.query("SELECT CAST(0 AS BIGINT) AS mismatches"))
def oracle_set_comparison(spark, d):
    """Forward against reversed rule and row order: resolution must not depend on it."""
    data = Data(spark, d)
    from ..operators import resolve

    flipped = evaluate.candidates(data.snap().orderBy(F.desc("employee_id")), fx.RULES[::-1], data.overrides, DAY)
    other = resolve.winners(resolve.judged(flipped, fx.CATEGORIES)).select("employee_id", "category_id", "policy_id")
    return verify.scope_mismatches(data.assigned(), other).agg(F.count("*").alias("mismatches"))


@register("latency_percentiles", "SELECT quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.99) AS p99 FROM orders")
def latency_percentiles(spark, d):
    return verify.percentiles(fx.read(spark, d, "orders"), "o_totalprice")


@register("work_avoided", "SELECT o_orderpriority AS kind, CAST(sum(o_orderkey % 7) AS BIGINT) AS executed, CAST(sum(10) AS BIGINT) AS \"full\", round(1 - sum(o_orderkey % 7) / sum(10), 5) AS avoided FROM orders GROUP BY 1")
def work_avoided(spark, d):
    runs = fx.read(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 7).alias("executed"), F.lit(10).cast("long").alias("full"))
    return verify.work_avoided(runs)


@register("mismatch_classes", o.query(
    "SELECT employee_id, category_id, CASE WHEN employee_id % 2 = 0 THEN 'DIVERGENCE' ELSE 'IMPACT_MISS' END AS kind FROM "
    "(SELECT employee_id, category_id, string_agg(policy_id, ',' ORDER BY policy_id) AS a FROM judged WHERE won GROUP BY ALL) FULL JOIN "
    "(SELECT employee_id, category_id, string_agg(policy_id, ',' ORDER BY policy_id) AS b FROM judged0 WHERE won GROUP BY ALL) USING (employee_id, category_id) WHERE a IS DISTINCT FROM b", *o.BASE, *o.BEFORE))
def mismatch_classes(spark, d):
    from .core import EARLIER

    data = Data(spark, d)
    seen = data.versions.where("employee_id % 2 = 0").select("employee_id", F.explode(F.array(*map(F.lit, fx.CATEGORIES))).alias("category_id"))
    return verify.classify(verify.scope_mismatches(data.assigned(), data.assigned(EARLIER)), seen).select("employee_id", "category_id", "kind")


@register("population_digest", o.query("SELECT sha256(string_agg(CAST(level AS VARCHAR), chr(10) ORDER BY employee_id)) AS digest FROM (SELECT employee_id, attr_level AS level FROM snap)", *SNAP))
def population_digest(spark, d):
    rows = Data(spark, d).snap().select("employee_id", F.variant_get("attributes", "$.level", "string").alias("level"))
    return verify.population_digest(rows, "employee_id", "level")
