"""Queries of the read routes over companies, jobs, audits and the overview."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import routes
from ..sources import fixtures as fx
from ..sources import requests
from . import oracle as o
from .core import DAY, register
from .state import Source

NOW = datetime.datetime(2002, 1, 1)
STATES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "DEAD", "WAITING", "SUCCEEDED")

JOBS = """jobs AS (SELECT o_orderkey AS job_id, 'c' || o_custkey % 3 AS company_id, o_custkey AS cust, list_extract(['EMPLOYEE', 'RULE', 'POLICY', 'GROUP', 'FULL'], CAST(o_orderkey % 5 AS INT) + 1) AS scope,
  list_extract(['PENDING', 'RUNNING', 'SUCCEEDED', 'FAILED', 'DEAD', 'WAITING', 'SUCCEEDED'], CAST(o_orderkey % 7 AS INT) + 1) AS status, CAST(o_orderdate AS DATE) AS created_on,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(CASE WHEN o_orderkey % 4 = 0 THEN epoch_ms(TIMESTAMP '2002-01-01') - epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) ELSE o_orderkey % 1000 * 1000 END AS BIGINT) END AS duration_ms,
  CAST(o_orderkey % 5 AS INT) AS k FROM orders),
totals AS (SELECT l_orderkey AS job_id, count(*) AS affected_scopes, CAST(sum(l_linenumber % 3) AS BIGINT) AS selected_assignments FROM lineitem GROUP BY ALL)"""


def jobs_of(spark, d):
    k, start = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("timestamp")
    scope = F.array(*map(F.lit, ("EMPLOYEE", "RULE", "POLICY", "GROUP", "FULL")))[(k % 5).cast("int")]
    payload = F.when(k % 5 == 0, F.to_json(F.struct(F.col("o_custkey").alias("employeeId")))).when(
        k % 5 == 1, F.lit('{"ruleVersionId":"r-urgent-v1"}')).when(k % 5 == 2, F.lit('{"policyId":"p-urgent"}')).when(
        k % 5 == 3, F.lit('{"groupId":"click"}')).otherwise("{}")
    began = F.when(k % 6 != 0, start)
    return fx.read(spark, d, "orders").select(
        k.alias("job_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("company_id"), scope.alias("scope"), payload.alias("payload"),
        F.array(*map(F.lit, STATES))[(k % 7).cast("int")].alias("status"), F.col("o_orderdate").cast("date").alias("created_on"),
        began.alias("started_at"), F.when(k % 4 != 0, F.timestamp_add("SECOND", (k % 1000).cast("int"), began)).alias("finished_at"))


def decisions_of(spark, d):
    """One decision a line item: it selects up to two policies."""
    return fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.slice(
        F.array(F.lit("a"), F.lit("b")), 1, (F.col("l_linenumber") % 3).cast("int")).alias("winners"))


@register("companies_page", "SELECT 'n' || n_nationkey AS company_id, n_name AS name, CASE WHEN n_nationkey % 6 = 1 THEN 'NYC_OPEN_DATA_PRODUCT' ELSE 'STANDARD' END AS workspace_kind, "
          "CASE WHEN n_nationkey % 6 = 1 THEN n_regionkey * 10 END AS imported_employee_count, (SELECT count(*) FROM nation WHERE n_nationkey % 5 <> 3) AS total FROM nation WHERE n_nationkey % 5 <> 3 "
          "ORDER BY CASE WHEN n_nationkey % 6 = 1 THEN 0 ELSE 1 END, n_regionkey, n_nationkey LIMIT 9 OFFSET 1")
def companies_page(spark, d):
    n = fx.read(spark, d, "nation").withColumn("company_id", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    table = n.select("company_id", F.col("n_name").alias("name"), F.col("n_regionkey").alias("created_at"), "n_nationkey")
    work = n.where("n_nationkey % 6 = 1").select("company_id", (F.col("n_regionkey") * 10).alias("imported_employee_count"))
    listed = routes.companies(table, work, n.where("n_nationkey % 5 = 3").select("company_id"))
    place = table.select("company_id", "n_nationkey")
    return routes.paged(listed.join(place, "company_id"), [F.asc("rank"), F.asc("created_at"), F.asc("n_nationkey")], 1, 9).select(
        "company_id", "name", "workspace_kind", "imported_employee_count", "total")


@register("jobs_page", "WITH " + JOBS + " SELECT job_id, scope, status, duration_ms, coalesce(affected_scopes, 0) AS affected_scopes, (SELECT count(*) FROM jobs WHERE company_id = 'c1') AS total "
          "FROM jobs LEFT JOIN totals USING (job_id) WHERE company_id = 'c1' ORDER BY created_on DESC, job_id DESC LIMIT 40 OFFSET 20")
def jobs_page(spark, d):
    jobs = routes.with_totals(jobs_of(spark, d).where("company_id = 'c1'"), decisions_of(spark, d), F.lit(NOW))
    return routes.paged(jobs, [F.desc("created_on"), F.desc("job_id")], 20, 40).select("job_id", "scope", "status", "duration_ms", "affected_scopes", "total")


NAMED = ("CASE k WHEN 0 THEN 'Employee ' || cust WHEN 1 THEN 'r-urgent' WHEN 2 THEN 'New p-urgent' WHEN 3 THEN 'CLICK' END")


@register("activity_feed", o.query(
    "SELECT company_id, job_id, scope, status, CASE WHEN k = 0 AND cust NOT IN (SELECT employee_id FROM ev) THEN NULL WHEN k = 3 AND company_id NOT IN (SELECT company_id FROM gm WHERE group_id = 'click') THEN NULL "
    f"ELSE {NAMED} END AS entity_name, coalesce(affected_scopes, 0) AS affected_scopes, coalesce(selected_assignments, 0) AS selected_assignments, duration_ms FROM jobs LEFT JOIN totals USING (job_id)", JOBS))
def activity_feed(spark, d):
    """Every job of every company with the entity that it is about."""
    s = Source(spark, d)
    employees = s.employees.withColumn("employee_name", F.concat(F.lit("Employee "), "employee_id"))
    names = s.policy_versions.where("valid_to IS NULL")
    jobs = routes.with_totals(jobs_of(spark, d), decisions_of(spark, d), F.lit(NOW))
    return routes.named(jobs, employees, s.rule_versions, names, s.groups).select(
        "company_id", "job_id", "scope", "status", "entity_name", "affected_scopes", "selected_assignments", "duration_ms")


@register("audit_rule_changes", "SELECT 'c1' AS company_id, r.rule_id, 2 AS version, '{\"priority\":' || p || ',\"enabled\":' || e || ',\"valid_from\":\"1990-01-01\",\"valid_to\":null}' AS before, "
          "'{\"priority\":' || (p + 1) || ',\"enabled\":' || e || ',\"valid_from\":\"1999-10-01\",\"valid_to\":null}' AS after FROM (VALUES ('r-any', 1, 'true'), ('r-urgent', 40, 'true'), ('r-off', 99, 'false')) r(rule_id, p, e)")
def audit_rule_changes(spark, d):
    first = Source(spark, d).rule_versions.where("company_id = 'c1' AND rule_id IN ('r-any', 'r-urgent', 'r-off')").drop("category_id")
    second = first.withColumns({"version": F.lit(2), "priority": F.col("priority") + 1, "valid_from": F.lit(datetime.date(1999, 10, 1))})
    return routes.rule_changes(first.unionByName(second)).select("company_id", "rule_id", "version", "before", "after")


@register("audit_overrides", o.query(
    "SELECT id, employee_id, 'Employee ' || employee_id AS employee_name, 'New ' || policy_id AS policy_name, action, reason, CASE WHEN revoked THEN valid_from + 30 ELSE valid_from END AS occurred_on "
    "FROM ov WHERE company_id = 'c1' AND employee_id IN (SELECT employee_id FROM ev) ORDER BY occurred_on DESC, id DESC LIMIT 50"))
def audit_overrides(spark, d):
    s = Source(spark, d)
    employees = s.employees.withColumn("employee_name", F.concat(F.lit("Employee "), "employee_id"))
    rows = s.overrides.where("company_id = 'c1'").withColumns({"created_on": F.col("valid_from"), "revoked_on": F.when(F.col("revoked"), F.date_add("valid_from", 30))})
    log = routes.override_log(rows, employees, s.policy_versions.where("valid_to IS NULL"))
    return log.orderBy(F.desc("occurred_on"), F.desc("id")).limit(50).select("id", "employee_id", "employee_name", "policy_name", "action", "reason", "occurred_on")


@register("audit_jobs", "WITH " + JOBS + " SELECT job_id, scope, status, created_on, duration_ms FROM jobs WHERE company_id = 'c2' ORDER BY created_on DESC, job_id DESC LIMIT 100")
def audit_jobs(spark, d):
    jobs = jobs_of(spark, d).where("company_id = 'c2'").withColumn("duration_ms", routes.duration_ms(F.lit(NOW)))
    return jobs.orderBy(F.desc("created_on"), F.desc("job_id")).limit(100).select("job_id", "scope", "status", "created_on", "duration_ms")


@register("overview", o.query(
    "SELECT (SELECT count(DISTINCT employee_id) FROM ev WHERE company_id = 'c1') AS employees, CAST(12 AS BIGINT) AS policies, CAST(12 AS BIGINT) AS rules, CAST(12 AS BIGINT) AS active_policies, CAST(11 AS BIGINT) AS active_rules, "
    "(SELECT count(*) FROM judged WHERE won AND employee_id % 3 = 1) AS assignments, "
    f"(SELECT count(*) FROM ov WHERE company_id = 'c1' AND NOT revoked AND {o.on(o.DAY)}) AS active_overrides, "
    "(SELECT count(*) FROM jobs WHERE company_id = 'c1' AND status IN ('PENDING', 'RUNNING', 'FAILED')) AS jobs_in_progress, (SELECT count(*) FROM jobs WHERE company_id = 'c1' AND status = 'DEAD') AS jobs_needing_attention, "
    "(SELECT count(*) FROM jobs JOIN lineitem ON l_orderkey = job_id WHERE company_id = 'c1' AND created_on >= DATE '1999-06-23' AND created_on <= DATE '1999-06-30') AS decisions_last_7_days", *o.BASE, JOBS))
def overview(spark, d):
    s, jobs = Source(spark, d), jobs_of(spark, d).where("company_id = 'c1'")
    from .core import Data

    mine = lambda t: t.where("company_id = 'c1'")
    recent = jobs.where(F.col("created_on").between(F.date_sub(F.lit(DAY), 7), F.lit(DAY)))
    return routes.overview({
        "employees": mine(s.employees), "policies": mine(s.policies), "rules": mine(s.rule_versions).select("rule_id").distinct(),
        "active_policies": mine(s.policy_versions).where("valid_to IS NULL AND enabled"),
        "active_rules": mine(s.rule_versions).where("status = 'PUBLISHED' AND enabled"), "assignments": Data(spark, d, "c1").assigned(),
        "active_overrides": routes.active_overrides(mine(s.overrides), DAY), "jobs_in_progress": jobs.where(F.col("status").isin(*routes.IN_PROGRESS)),
        "jobs_needing_attention": jobs.where("status = 'DEAD'"), "decisions_last_7_days": recent.join(decisions_of(spark, d), "job_id")})


@register("health", "SELECT 'ok' AS status")
def health(spark, d):
    return routes.health(spark)


@register("rule_policy_enabled", "SELECT company_id, rule_id, CASE WHEN policy_id LIKE 'k-%' AND company_id = 'c1' THEN FALSE ELSE company_id <> 'c2' END AS policy_enabled FROM (VALUES ('c0'), ('c1'), ('c2')) c(company_id), "
          "(VALUES ('r-any', 'p-default'), ('r-urgent', 'p-urgent'), ('r-machinery', 'p-machinery'), ('r-tenured', 'p-tenured'), ('r-group', 'p-group'), ('r-future', 'p-future'), ('r-off', 'p-off'), "
          "('k-place', 'k-place'), ('k-manager', 'k-manager'), ('k-level', 'k-level'), ('k-year', 'k-year')) r(rule_id, policy_id)")
def rule_policy_enabled(spark, d):
    """Published rules that have not ended, with whether their policy is enabled on the date; false without a version of it."""
    from ..operators.snapshot import rules_on

    s = Source(spark, d)
    versions = s.policy_versions.where("company_id <> 'c2'").withColumn("enabled", ~((F.col("company_id") == "c1") & F.col("policy_id").startswith("k-")))
    return rules_on(s.rule_versions, versions, DAY).select("company_id", "rule_id", "policy_enabled")


@register("categories_of_company", "SELECT c AS company_id, k AS category_id FROM (VALUES ('c0'), ('c1'), ('c2')) a(c), (VALUES ('main'), ('perks')) b(k)")
def categories_of_company(spark, d):
    return Source(spark, d).policies.select("company_id", "category_id").distinct()




REQUEST = "CASE WHEN k % 11 = 0 THEN 'not an object' WHEN k % 7 = 0 THEN 'key: pattern' WHEN k % 5 = 0 THEN 'name: required' WHEN k % 13 = 0 THEN 'name: null' WHEN k % 3 = 0 THEN 'description: long' END"


@register("request_errors", f"SELECT {REQUEST} AS error, count(*) AS n FROM (SELECT c_custkey AS k FROM customer) GROUP BY ALL")
def request_errors(spark, d):
    k = F.col("c_custkey")
    doc = F.when(k % 11 == 0, F.lit("[1]")).otherwise(F.concat(
        F.lit('{"key":"'), F.when(k % 7 == 0, "-x").otherwise("x.1"), F.lit('"'),
        F.when(k % 5 == 0, "").otherwise(F.when(k % 13 == 0, ',"name":null').otherwise(',"name":"Name"')),
        F.when(k % 3 == 0, F.concat(F.lit(',"description":"'), F.repeat(F.lit("d"), 2001), F.lit('"'))).otherwise(',"description":null'), F.lit(',"other":1}')))
    docs = fx.read(spark, d, "customer").select("c_custkey", doc.alias("document"))
    return requests.check(docs, "group").groupBy("error").agg(F.count("*").alias("n"))


OVERRIDES = (
    ('{"employeeId":"00000000-0000-4000-8000-000000000001","policyId":"00000000-0000-4000-8000-000000000002","action":"ASSIGN","reason":"r","validFrom":"2024-01-01","validTo":"2024-02-01"}', None),
    ('{"employeeId":"00000000-0000-4000-8000-000000000001","policyId":"x","action":"ASSIGN","reason":"r"}', "policyId: uuid"),
    ('{"employeeId":"00000000-0000-4000-8000-000000000001","policyId":"00000000-0000-4000-8000-000000000002","action":"MAYBE","reason":"r"}', "action: value"),
    ('{"employeeId":"00000000-0000-4000-8000-000000000001","policyId":"00000000-0000-4000-8000-000000000002","action":"EXCLUDE","priority":1000001,"reason":"r"}', "priority: range"),
    ('{"employeeId":"00000000-0000-4000-8000-000000000001","policyId":"00000000-0000-4000-8000-000000000002","action":"EXCLUDE","priority":1.5,"reason":"r"}', "priority: type"),
    ('{"employeeId":"00000000-0000-4000-8000-000000000001","policyId":"00000000-0000-4000-8000-000000000002","action":"EXCLUDE","reason":"r","validFrom":"2024-02-31"}', "validFrom: date"),
    ('{"employeeId":"00000000-0000-4000-8000-000000000001","policyId":"00000000-0000-4000-8000-000000000002","action":"EXCLUDE","reason":"r","validFrom":"2024-02-01","validTo":"2024-02-01"}', "validTo must be later than validFrom"))


@register("request_overrides", "SELECT * FROM (VALUES " + ", ".join(f"({n}, {'NULL' if e is None else chr(39) + e + chr(39)})" for n, (_, e) in enumerate(OVERRIDES)) + ") v(n, error)")
def request_overrides(spark, d):
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(OVERRIDES)], "n int, document string")
    return requests.check(docs, "override").select("n", "error")


RULES = (
    ('{"policyId":"00000000-0000-4000-8000-000000000002","key":"r","validFrom":"2024-01-01","condition":{"type":"group","groupId":"g","operator":"MEMBER_OF"}}', None),
    ('{"policyId":"00000000-0000-4000-8000-000000000002","key":"r","validFrom":"2024-01-01","condition":{"type":"xor"}}', "condition: unknown condition type"),
    ('{"policyId":"00000000-0000-4000-8000-000000000002","key":"r","validFrom":"2024-01-01","condition":{"type":"comparison","fact":{"kind":"as_of_date"},"operator":"EQ","value":"2024-02-31"}}', "condition: as_of_date values are ISO dates"))


@register("request_rules", "SELECT * FROM (VALUES " + ", ".join(f"({n}, {'NULL' if e is None else chr(39) + e + chr(39)})" for n, (_, e) in enumerate(RULES)) + ") v(n, error)")
def request_rules(spark, d):
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(RULES)], "n int, document string")
    return requests.check(docs, "rule").select("n", "error")


@register("inline_relations", "SELECT o_custkey AS employee_id, c AS category_id FROM orders, (VALUES ('main'), ('perks')) v(c) WHERE o_orderkey % 2 = 0 UNION ALL SELECT n, 'series' FROM range(1, 1202) t(n)")
def inline_relations(spark, d):
    """Record sets of two scopes in JSON, and a generated series."""
    texts = fx.read(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.to_json(F.transform(
        F.array(F.lit("main"), F.lit("perks")), lambda c: F.struct(F.col("o_custkey").alias("employee_id"), c.alias("category_id")))).alias("scopes"))
    sets = requests.record_set(texts, "scopes", "employee_id:bigint,category_id:string")
    return sets.unionByName(requests.series(spark, 1, 1201, "employee_id").withColumn("category_id", F.lit("series")))
