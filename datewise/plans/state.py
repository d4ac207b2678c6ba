"""Queries of source mutations, the impact dispatcher and reconciled generations."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch as batch_mod
from ..operators import dispatch
from ..operators import mutations as m
from ..sources import fixtures as fx
from ..sources.generations import State, work_dir
from . import oracle as o
from .core import DAY, DIFF, EARLIER, OV_DATES, SCOPES, Data, _policy_versions, register

COMPANIES = ("c0", "c1", "c2")


class Source(Data):
    """The tables that mutations change, of every company."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        self.versions = self.versions.withColumn("display_name", F.concat(F.lit("Employee "), "employee_id"))
        self.employees = self.versions.select("company_id", "employee_id", "external_id").distinct()
        self.groups = self.memberships.select("company_id", "group_id").distinct().withColumn("name", F.upper("group_id"))
        companies = F.explode(F.array(*map(F.lit, COMPANIES))).alias("company_id")
        self.policies = fx.policies(spark).select(companies, "policy_id", "category_id")
        self.policy_versions = _policy_versions(spark).select(companies, "*").withColumn("enabled", F.lit(True))
        self.rule_versions = fx.rule_table(spark).select(companies, "*").withColumns({"version": F.lit(1), "status": F.lit("PUBLISHED")})


def outcome(out: m.Outcome, requests: DataFrame, key: str) -> DataFrame:
    """company_id, what (event type or refusal), ref: every event and every refused request."""
    refused = out.refused.select("company_id", F.col("code").alias("what"), F.col(key).cast("string").alias("ref"),
                                 F.lit(None).cast("date").alias("at"))
    events = out.events.select("company_id", F.col("event_type").alias("what"), F.col("dedupe_key").alias("ref"), F.col("available_at").alias("at"))
    return events.unionByName(refused)


LATEST = "latest AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY version DESC) = 1)"
NULLS = {"display_name": "string", "email": "string", "location": "string", "department": "string", "employment_type": "string",
         "is_manager": "boolean", "hire_date": "date", "attributes_json": "string"}
GIVEN = ("CASE WHEN employee_id % 20 = 0 THEN DATE '1999-06-29' WHEN employee_id % 20 = 5 THEN DATE '1999-07-01' ELSE DATE '2002-01-01' END")


def _patches(s: Source) -> DataFrame:
    """Every employee is asked to change: dates by key, a location for some, an attribute for others, groups for a few."""
    e, k = s.employees, F.col("employee_id")
    facts = {n: F.lit(None).cast(t) for n, t in NULLS.items()}
    facts["location"] = F.when(k % 3 == 0, F.lit("MOVED"))
    facts["attributes_json"] = F.when(k % 7 == 0, F.lit('{"level":99}'))
    given = F.filter(F.array(F.when(k % 3 == 0, "location"), F.when(k % 7 == 0, "attributes_json")), lambda x: x.isNotNull())
    return e.select("company_id", "employee_id", F.expr(GIVEN).alias("effective_from"), given.alias("given"),
                    *[c.alias(n) for n, c in facts.items()],
                    F.when(k % 30 == 1, F.array(F.lit("click"))).when(k % 30 == 2, F.array(F.lit("nowhere"))).alias("group_ids"))


PATCH = ("patch AS (SELECT l.*, " + GIVEN + " AS eff FROM latest l), "
         "refusal AS (SELECT company_id, employee_id, CASE WHEN eff < DATE '1999-06-30' THEN 'BACKDATED_MUTATION' WHEN eff < valid_from THEN 'CONFLICT' "
         "WHEN employee_id % 30 = 2 THEN 'INVALID_REFERENCE' END AS what, eff FROM patch), "
         "fine AS (SELECT p.* FROM patch p JOIN refusal r USING (company_id, employee_id) WHERE r.what IS NULL), "
         "moved AS (SELECT * FROM fine WHERE employee_id % 3 = 0 OR employee_id % 7 = 0), "
         "held AS (SELECT f.company_id, f.employee_id, g.group_id, f.eff FROM fine f JOIN gm g ON g.employee_id = f.employee_id AND g.valid_from <= f.eff "
         "AND (g.valid_to IS NULL OR g.valid_to > f.eff) WHERE f.employee_id % 30 = 1)")
PATCHED = ("SELECT company_id, what, CAST(employee_id AS VARCHAR) AS ref, CAST(NULL AS DATE) AS at FROM refusal WHERE what IS NOT NULL UNION ALL "
           "SELECT company_id, 'EMPLOYEE_UPDATED', 'employee:' || employee_id || ':version:' || (version + 1), eff FROM moved UNION ALL "
           "SELECT company_id, 'GROUP_MEMBERSHIP_ADDED', 'membership:click:' || employee_id || ':' || eff || ':added', eff FROM fine WHERE employee_id % 30 = 1 "
           "AND employee_id NOT IN (SELECT employee_id FROM held WHERE group_id = 'click') UNION ALL "
           "SELECT company_id, 'GROUP_MEMBERSHIP_REMOVED', 'membership:' || group_id || ':' || employee_id || ':' || eff || ':removed', eff FROM held WHERE group_id <> 'click'")


@register("mutate_employees", o.query(PATCHED, LATEST, PATCH))
def mutate_employees(spark, d):
    s = Source(spark, d)
    asked = _patches(s)
    return outcome(m.patch_employees(s.versions, s.memberships, s.groups, asked, DAY), asked, "employee_id")


@register("mutated_versions", o.query(
    "SELECT employee_id, version, valid_from, valid_to, location, CAST(attr_level AS INT) AS level, CAST(NULL AS VARCHAR) AS changed FROM ev WHERE (employee_id, version) NOT IN (SELECT (employee_id, version) FROM moved) "
    "UNION ALL SELECT employee_id, version, valid_from, eff, location, attr_level, NULL FROM moved UNION ALL "
    "SELECT employee_id, version + 1, eff, NULL, CASE WHEN employee_id % 3 = 0 THEN 'MOVED' ELSE location END, CASE WHEN employee_id % 7 = 0 THEN 99 ELSE attr_level END, "
    "concat_ws(',', CASE WHEN employee_id % 7 = 0 THEN 'attributes.level' END, CASE WHEN employee_id % 7 = 0 AND status_present THEN 'attributes.status' END, "
    "CASE WHEN employee_id % 3 = 0 THEN 'location' END) FROM moved", LATEST, PATCH))
def mutated_versions(spark, d):
    s = Source(spark, d)
    s.versions = s.versions.withColumn("changed_fields", F.lit(None).cast("array<string>"))
    v = m.patch_employees(s.versions, s.memberships, s.groups, _patches(s), DAY).tables["versions"]
    return v.select("employee_id", "version", "valid_from", "valid_to", "location",
                    F.variant_get(F.parse_json("attributes_json"), "$.level", "int").alias("level"), F.array_join("changed_fields", ",").alias("changed"))


@register("mutate_hires", o.query(
    "SELECT 'c' || s_suppkey % 3 AS company_id, 'EMPLOYEE_CREATED' AS what, 'employee:' || (1000000 + s_suppkey) || ':version:1' AS ref, "
    "CASE WHEN s_suppkey % 2 = 0 THEN DATE '1999-07-15' ELSE DATE '1999-06-30' END AS at FROM supplier WHERE s_suppkey % 5 NOT IN (3, 4) UNION ALL "
    "SELECT 'c' || s_suppkey % 3, CASE s_suppkey % 5 WHEN 3 THEN 'INVALID_REFERENCE' ELSE 'CONFLICT' END, CAST(1000000 + s_suppkey AS VARCHAR), NULL FROM supplier WHERE s_suppkey % 5 IN (3, 4)"))
def mutate_hires(spark, d):
    s, k = Source(spark, d), F.col("s_suppkey")
    # Some take an external id that is taken in their company: that of an employee of the same remainder.
    taken = F.concat(F.lit("E-"), F.lpad((k % 3).cast("string"), 9, "0"))
    asked = fx.read(spark, d, "supplier").select(
        F.concat(F.lit("c"), (k % 3).cast("string")).alias("company_id"), (k + 1000000).alias("employee_id"),
        F.when(k % 5 == 4, taken).otherwise(F.concat(F.lit("N-"), k.cast("string"))).alias("external_id"),
        *[(F.col("s_name") if n == "display_name" else F.lit(None).cast(t)).alias(n) for n, t in NULLS.items()],
        F.when(k % 2 == 0, F.lit(datetime.date(1999, 7, 15))).alias("effective_from"),
        F.when(k % 5 == 3, F.array(F.lit("nowhere"))).otherwise(F.array().cast("array<string>")).alias("group_ids"))
    return outcome(m.create_employees(s.employees, s.versions, s.memberships, s.groups, asked, DAY), asked, "employee_id")


BORN = "born AS (SELECT company_id, employee_id, min(valid_from) AS born FROM ev GROUP BY ALL)"


@register("mutate_members", o.query(
    "SELECT company_id, 'GROUP_MEMBERSHIP_ADDED' AS what, 'membership:view:' || employee_id || ':2002-01-01:added' AS ref, DATE '2002-01-01' AS at FROM born WHERE employee_id % 4 = 0 "
    "AND employee_id NOT IN (SELECT employee_id FROM gm WHERE group_id = 'view' AND (valid_to IS NULL OR valid_to > DATE '2002-01-01')) "
    "AND company_id IN (SELECT company_id FROM gm WHERE group_id = 'view') UNION ALL "
    "SELECT company_id, CASE WHEN employee_id % 4 = 1 THEN 'BACKDATED_MUTATION' WHEN company_id NOT IN (SELECT company_id FROM gm WHERE group_id = 'view') THEN 'NOT_FOUND' ELSE 'CONFLICT' END, CAST(employee_id AS VARCHAR), NULL FROM born "
    "WHERE employee_id % 4 = 1 OR (employee_id % 4 = 0 AND (company_id NOT IN (SELECT company_id FROM gm WHERE group_id = 'view') OR "
    "employee_id IN (SELECT employee_id FROM gm WHERE group_id = 'view' AND (valid_to IS NULL OR valid_to > DATE '2002-01-01'))))", BORN))
def mutate_members(spark, d):
    s, k = Source(spark, d), F.col("employee_id")
    asked = s.employees.where("employee_id % 4 IN (0, 1)").select("company_id", "employee_id", F.lit("view").alias("group_id"),
        F.when(k % 4 == 1, F.lit(datetime.date(1999, 6, 1))).otherwise(F.lit(datetime.date(2002, 1, 1))).alias("effective_from"))
    return outcome(m.add_members(s.memberships, s.groups, s.versions, asked, DAY), asked, "employee_id")


@register("mutate_leavers", o.query(
    f"SELECT company_id, group_id, employee_id, valid_from, CASE WHEN {o.on(o.DAY)} THEN {o.DAY} ELSE valid_to END AS valid_to FROM gm"))
def mutate_leavers(spark, d):
    s = Source(spark, d)
    asked = s.memberships.select("company_id", "employee_id", "group_id", F.lit(None).cast("date").alias("effective_from")).distinct()
    return m.remove_members(s.memberships, asked, DAY).tables["memberships"].select("company_id", "group_id", "employee_id", "valid_from", "valid_to")


@register("mutate_policies", "SELECT c.company_id, p.policy_id, v.version, v.valid_from, v.valid_to, v.name FROM (VALUES ('c0'), ('c1'), ('c2')) c(company_id), "
          "(VALUES ('k-level'), ('k-manager'), ('k-place'), ('k-year'), ('p-default'), ('p-ended'), ('p-future'), ('p-group'), ('p-machinery'), ('p-off'), ('p-tenured'), ('p-urgent')) p(policy_id), "
          "LATERAL (SELECT 1 AS version, DATE '1990-01-01' AS valid_from, DATE '1999-01-01' AS valid_to, 'Old ' || p.policy_id AS name UNION ALL "
          "SELECT 2, DATE '1999-01-01', CASE WHEN p.policy_id LIKE 'k-%' AND c.company_id = 'c1' THEN DATE '1999-08-01' END, 'New ' || p.policy_id UNION ALL "
          "SELECT 3, DATE '1999-08-01', NULL, 'Newest' WHERE p.policy_id LIKE 'k-%' AND c.company_id = 'c1') v")
def mutate_policies(spark, d):
    s = Source(spark, d)
    asked = s.policies.where("policy_id LIKE 'k-%' AND company_id <> 'c0'").select(
        "company_id", "policy_id", F.lit("Newest").alias("name"), F.lit(None).cast("boolean").alias("enabled"),
        F.when(F.col("company_id") == "c1", F.lit(datetime.date(1999, 8, 1))).otherwise(F.lit(datetime.date(1999, 1, 1))).alias("effective_from"))
    return m.publish_policy_versions(s.policy_versions, asked, DAY).tables["versions"].select("company_id", "policy_id", "version", "valid_from", "valid_to", "name")


def _drafted(s: Source) -> tuple[m.Outcome, DataFrame]:
    asked = s.rule_versions.where("company_id <> 'c0'").select(
        "company_id", "rule_id", F.concat("rule_id", F.lit("-v2")).alias("version_id"),
        F.when(F.col("rule_id") == "r-any", F.lit("k-place")).otherwise(F.col("policy_id")).alias("policy_id"), (F.col("priority") + 1).alias("priority"),
        "enabled", F.when(F.col("rule_id") == "k-year", F.lit(datetime.date(1999, 6, 1))).otherwise(F.lit(datetime.date(1999, 10, 1))).alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"))
    return m.draft_rule_versions(s.rule_versions, s.policies, asked), asked


RULE_IDS = "(VALUES ('r-any'), ('r-urgent'), ('r-machinery'), ('r-tenured'), ('r-group'), ('r-future'), ('r-ended'), ('r-off'), ('k-place'), ('k-manager'), ('k-level'), ('k-year')) r(rule_id)"


@register("mutate_rules", f"SELECT company_id, CASE rule_id WHEN 'r-any' THEN 'RULE_CATEGORY_IMMUTABLE' WHEN 'k-year' THEN 'BACKDATED_MUTATION' ELSE 'RULE_VERSION_PUBLISHED' END AS what, "
          f"CASE WHEN rule_id = 'r-any' THEN 'r-any' WHEN rule_id = 'k-year' THEN 'k-year-v2' ELSE 'rule:' || rule_id || ':version:2:published' END AS ref, "
          f"CASE WHEN rule_id NOT IN ('r-any', 'k-year') THEN DATE '1999-10-01' END AS at FROM {RULE_IDS}, (VALUES ('c1'), ('c2')) c(company_id)")
def mutate_rules(spark, d):
    s = Source(spark, d)
    drafted, asked = _drafted(s)
    publish = drafted.tables["versions"].where("status = 'DRAFT'").select("company_id", "rule_id", "version_id")
    out = m.publish_rule_versions(drafted.tables["versions"], publish, DAY)
    refused = drafted.refused.select("company_id", F.col("code").alias("what"), F.col("rule_id").alias("ref"), F.lit(None).cast("date").alias("at"))
    return outcome(out, publish, "version_id").unionByName(refused)


@register("mutated_rules", f"SELECT company_id, rule_id, 1 AS version, 'PUBLISHED' AS status, CASE WHEN company_id <> 'c0' AND rule_id NOT IN ('r-any', 'k-year') THEN DATE '1999-10-01' WHEN rule_id = 'r-ended' THEN DATE '1999-06-30' END AS valid_to FROM {RULE_IDS}, (VALUES ('c0'), ('c1'), ('c2')) c(company_id) "
          f"UNION ALL SELECT company_id, rule_id, 2, CASE WHEN rule_id = 'k-year' THEN 'DRAFT' ELSE 'PUBLISHED' END, NULL FROM {RULE_IDS}, (VALUES ('c1'), ('c2')) c(company_id) WHERE rule_id <> 'r-any'")
def mutated_rules(spark, d):
    drafted, _ = _drafted(Source(spark, d))
    publish = drafted.tables["versions"].where("status = 'DRAFT'").select("company_id", "rule_id", "version_id")
    return m.publish_rule_versions(drafted.tables["versions"], publish, DAY).tables["versions"].select("company_id", "rule_id", "version", "status", "valid_to")


@register("mutate_overrides", o.query(
    "SELECT 'c' || employee_id % 3 AS company_id, CASE WHEN employee_id % 6 = 0 THEN 'BACKDATED_MUTATION' WHEN employee_id % 6 = 1 THEN 'VALIDATION_ERROR' WHEN employee_id % 6 = 2 THEN 'NOT_FOUND' "
    "WHEN DATE '1999-07-01' < born THEN 'INVALID_EFFECTIVE_DATE' ELSE 'MANUAL_OVERRIDE_CREATED' END AS what, "
    "CASE WHEN employee_id % 6 < 3 OR DATE '1999-07-01' < born THEN CAST(employee_id + 90000000 AS VARCHAR) ELSE 'override:' || (employee_id + 90000000) || ':created' END AS ref, "
    "CASE WHEN employee_id % 6 >= 3 AND DATE '1999-07-01' >= born THEN DATE '1999-07-01' END AS at FROM born", BORN))
def mutate_overrides(spark, d):
    s, k = Source(spark, d), F.col("employee_id")
    day = datetime.date
    asked = s.employees.select("company_id", (k + 90000000).alias("id"), "employee_id",
        F.when(k % 6 == 2, F.lit("p-none")).otherwise(F.lit("p-urgent")).alias("policy_id"), F.lit("ASSIGN").alias("action"), F.lit(3).alias("priority"),
        F.lit("asked for").alias("reason"), F.when(k % 6 == 0, F.lit(day(1999, 6, 1))).otherwise(F.lit(day(1999, 7, 1))).alias("valid_from"),
        F.when(k % 6 == 1, F.lit(day(1999, 7, 1))).alias("valid_to"))
    return outcome(m.create_overrides(s.overrides, s.policies, s.versions, asked, DAY), asked, "id")


@register("mutate_revocations", o.query(
    f"SELECT id, CASE WHEN NOT revoked AND id % 2 = 0 AND valid_from < {o.DAY} THEN least(coalesce(valid_to, {o.DAY}), {o.DAY}) ELSE valid_to END AS valid_to, revoked OR id % 2 = 0 AS revoked FROM ov"))
def mutate_revocations(spark, d):
    s = Source(spark, d)
    asked = s.overrides.where("id % 2 = 0").select("company_id", "id")
    return m.revoke_overrides(s.overrides, asked, DAY).tables["overrides"].select("id", "valid_to", "revoked")


@register("mutate_names", "SELECT 'c0' AS company_id, 'billing' AS group_id, 'Billing' AS name, CAST(NULL AS VARCHAR) AS code UNION ALL SELECT 'c1', 'support', 'Help', NULL UNION ALL "
          "SELECT 'c0', 'support', 'Support', NULL UNION ALL SELECT 'c0', 'billing', 'Twice', 'CONFLICT' UNION ALL SELECT 'c2', 'support', 'Nobody', 'NOT_FOUND'")
def mutate_names(spark, d):
    """Groups of a company are created and renamed; the same key in another company is free."""
    kind = "company_id string, group_id string, name string"
    table = spark.createDataFrame([("c0", "support", "Support"), ("c1", "support", "Support")], kind)
    first = m.insert_named(table, spark.createDataFrame([("c0", "billing", "Billing")], kind), "group_id")
    again = m.insert_named(first.tables["table"], spark.createDataFrame([("c0", "billing", "Twice")], kind), "group_id")
    last = m.rename(again.tables["table"], spark.createDataFrame([("c1", "support", "Help"), ("c2", "support", "Nobody")], kind), "group_id", ("name",))
    return last.tables["table"].withColumn("code", F.lit(None).cast("string")).unionByName(again.refused).unionByName(last.refused)


@register("mutate_categories", "SELECT 'main' AS category_id, 'Main choice' AS name, 'SINGLE' AS cardinality, CAST(NULL AS VARCHAR) AS code UNION ALL SELECT 'perks', 'Perks', 'MULTIPLE', NULL UNION ALL SELECT 'perks', 'x', 'SINGLE', 'IMMUTABLE'")
def mutate_categories(spark, d):
    kind = "company_id string, category_id string, name string, cardinality string"
    table = spark.createDataFrame([("c0", "main", "Main", "SINGLE"), ("c0", "perks", "Perks", "MULTIPLE")], kind)
    asked = spark.createDataFrame([("c0", "main", "Main choice", None), ("c0", "perks", "x", "SINGLE")], kind)
    out = m.rename(table, asked, "category_id", ("name",), ("cardinality",))
    return out.tables["table"].withColumn("code", F.lit(None).cast("string")).unionByName(out.refused).drop("company_id")


@register("event_outbox", o.query(
    "SELECT what AS event_type, count(*) AS n FROM (" + PATCHED + ") WHERE \"at\" IS NOT NULL GROUP BY ALL UNION ALL SELECT 'MANUAL_FULL_RECONCILIATION', 3", LATEST, PATCH))
def event_outbox(spark, d):
    """Events of two kinds are appended, and appended again: the second time nothing is added."""
    s = Source(spark, d)
    asked = spark.createDataFrame([(c, f"r-{c}") for c in COMPANIES], "company_id string, request_id string")
    queue = m.trigger_full(asked, DAY).events
    events = m.patch_employees(s.versions, s.memberships, s.groups, _patches(s), DAY).events
    twice = m.append_events(m.append_events(queue, events), events.unionByName(queue))
    return twice.groupBy("event_type").agg(F.count("*").alias("n"))


# Events of every scope, several of each.
EVENTS = (
    (1, "EMPLOYEE", '{"employeeId":7,"categoryIds":["perks"]}'), (2, "EMPLOYEE", '{"employeeId":8}'),
    (3, "EMPLOYEE", '{"employeeId":9,"changedFields":["location","attributes.level"]}'), (4, "EMPLOYEE", '{"employeeId":9,"changedFields":["email"]}'),
    (5, "GROUP", '{"employeeId":10,"groupId":"click"}'), (6, "GROUP", '{"employeeId":10,"groupId":"nowhere"}'),
    (7, "RULE", '{"ruleVersionId":"r-machinery-v1","previousRuleVersionId":"k-manager-v1"}'), (8, "RULE", '{"ruleVersionId":"r-none-v1"}'),
    (9, "POLICY", '{"policyId":"p-urgent"}'), (10, "POLICY", '{"policyId":"p-none"}'), (11, "OVERRIDE", '{"employeeId":12,"categoryId":"main"}'),
    (12, "TEMPORAL", '{"employeeId":13,"categoryId":"perks"}'),
    (13, "FANOUT", '{"scopes":[{"employeeId":1,"categoryId":"main"},{"employeeId":2,"categoryId":"main"}]}'),
    (14, "FANOUT", '{"scopes":[{"employeeId":1,"categoryId":"main"},{"employeeId":1,"categoryId":"main"}]}'), (15, "FULL", "{}"), (16, "OTHER", "{}"))


def _analyzed(spark, d):
    data = Data(spark, d)
    events = spark.createDataFrame(list(EVENTS), "event_id int, scope string, payload string")
    return dispatch.analyze(events, data.snap(), data.assigned(), fx.RULES, list(fx.CATEGORIES), DAY)


@register("impact_dispatch", o.query(
    "SELECT 1 AS event_id, 7 AS employee_id, 'perks' AS category_id UNION ALL SELECT 2, 8, 'main' UNION ALL SELECT 2, 8, 'perks' UNION ALL SELECT 3, 9, 'main' UNION ALL SELECT 3, 9, 'perks' UNION ALL "
    "SELECT 5, 10, 'main' UNION ALL SELECT 7, employee_id, 'main' FROM snap WHERE department = 'MACHINERY' UNION ALL SELECT 7, employee_id, 'perks' FROM snap WHERE is_manager UNION ALL "
    "(SELECT 9, employee_id, 'main' FROM snap WHERE employment_type = '1-URGENT' UNION SELECT 9, employee_id, category_id FROM judged WHERE won AND policy_id = 'p-urgent') UNION ALL "
    "SELECT 11, 12, 'main' UNION ALL SELECT 12, 13, 'perks' UNION ALL SELECT 13, 1, 'main' UNION ALL SELECT 13, 2, 'main' UNION ALL SELECT 15, employee_id, c FROM snap, (VALUES ('main'), ('perks')) v(c)", *o.BASE))
def impact_dispatch(spark, d):
    return _analyzed(spark, d)[0]


@register("impact_errors", "SELECT * FROM (VALUES (8, 'MISSING_RULE_VERSION'), (10, 'MISSING_POLICY'), (14, 'DUPLICATE_SCOPES'), (16, 'UNSUPPORTED_SCOPE')) v(event_id, error)")
def impact_errors(spark, d):
    return _analyzed(spark, d)[1]


def reconciled(spark, d) -> State:
    """Two days for everyone, the second with a replay, then a third batch of some scopes on the same day."""
    state, data = State(spark, work_dir(spark, "reconciled")), Data(spark, d)
    for batch, day, few in (("first", EARLIER, False), ("second", DAY, False), ("second", DAY, False), ("third", DAY, True)):
        scopes = data.scopes(day)
        batch_mod.reconcile_batch(state, scopes.where("employee_id % 10 = 0") if few else scopes, data.snap(day), fx.RULES, data.overrides,
                                  fx.CATEGORIES, day, batch)
    return state


@register("reconciled_assignments", o.query(
    "SELECT employee_id, category_id, policy_id, CASE WHEN category_id = 'main' THEN category_id ELSE policy_id END AS slot_key, "
    "CASE WHEN state = 'ADDED' THEN DATE '1999-06-30' ELSE DATE '1998-12-31' END AS effective_from FROM diff WHERE state <> 'REMOVED'", *o.BASE, *o.BEFORE, DIFF))
def reconciled_assignments(spark, d):
    return reconciled(spark, d).read("assignments", batch_mod.ASSIGNMENTS).drop("decision_id")


@register("reconciled_history", o.query(
    "SELECT employee_id, category_id, policy_id, DATE '1998-12-31' AS valid_from, CASE WHEN state = 'REMOVED' THEN DATE '1999-06-30' END AS valid_to FROM diff WHERE state <> 'ADDED' "
    "UNION ALL SELECT employee_id, category_id, policy_id, DATE '1999-06-30', NULL FROM diff WHERE state = 'ADDED'", *o.BASE, *o.BEFORE, DIFF))
def reconciled_history(spark, d):
    return reconciled(spark, d).read("history", batch_mod.HISTORY)


@register("reconciled_decisions", o.query(
    f"SELECT employee_id, category_id, DATE '1998-12-31' AS as_of, w AS winners FROM {SCOPES.format('snap0')} LEFT JOIN (SELECT employee_id, category_id, string_agg(policy_id, ',' ORDER BY candidate_id) AS w FROM judged0 WHERE won GROUP BY ALL) USING (employee_id, category_id) UNION ALL "
    f"SELECT employee_id, category_id, DATE '1999-06-30', w FROM {SCOPES.format('snap')} LEFT JOIN (SELECT employee_id, category_id, string_agg(policy_id, ',' ORDER BY candidate_id) AS w FROM judged WHERE won GROUP BY ALL) USING (employee_id, category_id)", *o.BASE, *o.BEFORE))
def reconciled_decisions(spark, d):
    """One decision a scope and day: neither the replay nor the third batch, whose inputs are the same, adds any."""
    e = reconciled(spark, d).read("decisions", batch_mod.DECISIONS)
    return e.select("employee_id", "category_id", "as_of", F.nullif(F.array_join("winners", ","), F.lit("")).alias("winners"))


@register("reconciled_timers", o.query(
    f"SELECT employee_id, category_id, source, source_id, date FROM (SELECT employee_id, category_id, 'OVERRIDE' AS source, source_id, date FROM ({OV_DATES}) UNION ALL "
    f"SELECT employee_id, 'main', 'RULE', 'r-tenured-v1', hire_date + 730 FROM snap WHERE hire_date + 730 > {o.DAY} UNION ALL SELECT employee_id, 'main', 'RULE', 'r-future-v1', DATE '1999-09-01' FROM snap "
    f"UNION ALL SELECT employee_id, 'perks', 'RULE', 'k-year-v1', DATE '2000-01-01' FROM snap) JOIN {SCOPES.format('snap')} USING (employee_id, category_id)", o.snap()))
def reconciled_timers(spark, d):
    """Timers after the later date, of scopes that it knows."""
    t, data = reconciled(spark, d).read("transitions", batch_mod.TRANSITIONS), Data(spark, d)
    return t.where(F.col("date") > F.lit(DAY)).join(data.scopes(), ["employee_id", "category_id"], "left_semi").drop("processed")
