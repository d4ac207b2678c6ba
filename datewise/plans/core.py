"""Queries of the rule engine proper: snapshots, rules, resolution, impact, reconciliation, previews."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.rules import all_of, any_of, compare, compile_rule, group, none_of
from ..operators import evaluate, explain, impact, preview, reconcile, resolve
from ..operators import snapshot as snapshots
from ..sources import fixtures as fx
from . import oracle as o

DAY = fx.AS_OF
EARLIER = datetime.date(1998, 12, 31)
QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


class Data:
    """The derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, company_id: str | None = None):
        """With a company, every table is filtered to it at its scan."""
        tables = (fx.employee_versions(spark, sf_dir), fx.group_memberships(spark, sf_dir), fx.manual_overrides(spark, sf_dir))
        if company_id is not None:
            tables = [t.where(F.col("company_id") == F.lit(company_id)) for t in tables]
        self.spark = spark
        self.versions, self.memberships, self.overrides = tables

    def scopes(self, day=DAY) -> DataFrame:
        return impact.full_impact(self.snap(day), list(fx.CATEGORIES))

    def snap(self, day=DAY) -> DataFrame:
        return snapshots.snapshot(self.versions, self.memberships, day)

    def judged(self, day=DAY, with_trace=False) -> DataFrame:
        return resolve.judged(evaluate.candidates(self.snap(day), fx.RULES, self.overrides, day, with_trace), fx.CATEGORIES)

    def assigned(self, day=DAY) -> DataFrame:
        return resolve.winners(self.judged(day)).select("employee_id", "category_id", "policy_id")


SNAP_COLUMNS = "employee_id, version_id, version, location, department, employment_type, is_manager, hire_date"


@register("asof_snapshot", o.query(f"SELECT {SNAP_COLUMNS}, array_to_string(group_ids, ',') AS groups, attr_level AS level FROM snap", o.snap()))
def asof_snapshot(spark, d):
    return Data(spark, d).snap().select(*SNAP_COLUMNS.split(", "), F.array_join("group_ids", ",").alias("groups"),
                                        F.variant_get("attributes", "$.level", "int").alias("level"))


@register("asof_groups_agg", o.query(f"SELECT employee_id, string_agg(DISTINCT group_id, ',' ORDER BY group_id) AS groups FROM gm WHERE {o.on(o.DAY)} GROUP BY employee_id"))
def asof_groups_agg(spark, d):
    return snapshots.groups_on(fx.group_memberships(spark, d), DAY).select("employee_id", F.array_join("group_ids", ",").alias("groups"))


@register("version_overlap_violations", o.query(
    "SELECT employee_id, id, valid_from, valid_to, next_from FROM (SELECT employee_id, id, valid_from, valid_to, "
    "LEAD(valid_from) OVER (PARTITION BY employee_id ORDER BY valid_from, id) AS next_from FROM ov) "
    "WHERE next_from IS NOT NULL AND (valid_to IS NULL OR valid_to > next_from)"))
def version_overlap_violations(spark, d):
    return temporal.overlaps(fx.manual_overrides(spark, d).select("employee_id", "id", "valid_from", "valid_to"), ["employee_id"], "id")


@register("scd2_before_after", o.query(
    "SELECT employee_id, version, location, LAG(location) OVER w AS location_before, employment_type, "
    "LAG(employment_type) OVER w AS employment_type_before FROM ev WINDOW w AS (PARTITION BY employee_id ORDER BY version)"))
def scd2_before_after(spark, d):
    v = temporal.before_after(fx.employee_versions(spark, d), ["employee_id"], "version", ["location", "employment_type"])
    return v.select("employee_id", "version", "location", F.col("before.location").alias("location_before"), "employment_type",
                    F.col("before.employment_type").alias("employment_type_before"))


@register("scd2_append", o.query(
    f"SELECT employee_id, version, location, valid_from, CASE WHEN employee_id % 10 = 0 AND {o.on(o.DAY)} THEN {o.DAY} ELSE valid_to END AS valid_to FROM ev "
    f"UNION ALL SELECT employee_id, CAST(max(version) + 1 AS INT), 'MOVED', {o.DAY}, CAST(NULL AS DATE) FROM ev WHERE employee_id % 10 = 0 GROUP BY employee_id"))
def scd2_append(spark, d):
    v = fx.employee_versions(spark, d).select("employee_id", "version", "location", "valid_from", "valid_to")
    changes = v.where("employee_id % 10 = 0").select("employee_id").distinct().select(
        "employee_id", F.lit(DAY).alias("effective_from"), F.lit("MOVED").alias("location"))
    return temporal.append_version(v, changes, ["employee_id"])


@register("changed_fields", o.query(
    "SELECT employee_id, version, concat_ws(',', CASE WHEN employment_type IS DISTINCT FROM e0 THEN 'employment_type' END, "
    "CASE WHEN location IS DISTINCT FROM l0 THEN 'location' END) AS changed FROM (SELECT *, LAG(location) OVER w AS l0, "
    "LAG(employment_type) OVER w AS e0 FROM ev WINDOW w AS (PARTITION BY employee_id ORDER BY version)) WHERE version > 1"))
def changed_fields(spark, d):
    names = ["employment_type", "location"]
    v = temporal.before_after(fx.employee_versions(spark, d), ["employee_id"], "version", names).where("version > 1")
    return v.select("employee_id", "version", F.array_join(
        temporal.changed_fields(F.col("before"), F.struct(*names), names), ",").alias("changed"))


RULE_CASES = {
    "rule_eq": (compare("employment_type", "EQ", "1-URGENT"), "coalesce(employment_type = '1-URGENT', FALSE)"),
    "rule_eq_null": (compare("employment_type", "EQ", None), "employment_type IS NULL"),
    "rule_ne": (compare("employment_type", "NE", "1-URGENT"), "employment_type IS DISTINCT FROM '1-URGENT'"),
    "rule_gt": (compare("attribute.level", "GT", 4), "attr_level > 4"),
    "rule_gte": (compare("hire_date", "GTE", "1995-03-01"), "coalesce(hire_date >= DATE '1995-03-01', FALSE)"),
    "rule_lt": (compare("location", "LT", "NATION_2"), "location < 'NATION_2'"),
    "rule_lte": (compare("attribute.status", "LTE", "F"), "coalesce(attr_status <= 'F', FALSE)"),
    "rule_in": (compare("employment_type", "IN", ["1-URGENT", "5-LOW", None]), "employment_type IN ('1-URGENT', '5-LOW') OR employment_type IS NULL"),
    "rule_not_in": (compare("employment_type", "NOT_IN", ["1-URGENT", "2-HIGH"]), "coalesce(employment_type NOT IN ('1-URGENT', '2-HIGH'), TRUE)"),
    "rule_type_mismatch": (compare("attribute.level", "NE", "4"), "TRUE"),
    "rule_attr_eq_number": (compare("attribute.level", "EQ", 4.0), "attr_level = 4"),
    "rule_attr_missing": (compare("attribute.status", "NE", "O"), "status_present AND attr_status IS DISTINCT FROM 'O'"),
    "rule_attr_null": (compare("attribute.status", "EQ", None), "status_present AND attr_status IS NULL"),
    "rule_attr_not_in": (compare("attribute.status", "NOT_IN", ["O", "P"]), "status_present AND coalesce(attr_status NOT IN ('O', 'P'), TRUE)"),
    "rule_tenure": (compare("tenure_days", "GT", 1000), "coalesce(tenure > 1000, FALSE)"),
    "rule_tenure_ne": (compare("tenure_days", "NE", 1000), "coalesce(tenure <> 1000, FALSE)"),
    "rule_as_of": (any_of(all_of(compare("as_of_date", "IN", ["1999-06-30", "1999-07-01"]), compare("is_manager", "EQ", True)), all_of(compare("as_of_date", "GT", "1999-06-30"), compare("is_manager", "EQ", False))), "is_manager"),
    "rule_manager": (compare("is_manager", "NE", True), "NOT is_manager"),
    "rule_external_id": (compare("external_id", "LT", "E-000000100"), "external_id < 'E-000000100'"),
    "rule_email_null": (compare("email", "EQ", None), "email IS NULL"),
    "rule_email": (compare("email", "NOT_IN", ["u7@example.org", None]), "email <> 'u7@example.org'"),
    "rule_member": (group("click"), "list_contains(group_ids, 'click')"),
    "rule_not_member": (group("click", "NOT_MEMBER_OF"), "NOT list_contains(group_ids, 'click')"),
    "rule_and": (all_of(compare("is_manager", "EQ", True), compare("department", "EQ", "BUILDING")), "is_manager AND department = 'BUILDING'"),
    "rule_or": (any_of(compare("attribute.level", "EQ", 1), group("view")), "attr_level = 1 OR list_contains(group_ids, 'view')"),
    "rule_not": (none_of(compare("attribute.status", "EQ", "O")), "NOT coalesce(attr_status = 'O', FALSE)"),
}


def _rule_case(condition):
    def run(spark, d):
        rule = compile_rule(condition, F.lit(DAY))
        return Data(spark, d).snap().where(rule.predicate).select("employee_id")

    return run


for _name, (_condition, _sql) in RULE_CASES.items():
    register(_name, o.query(f"SELECT employee_id FROM snap WHERE {_sql}", o.snap()))(_rule_case(_condition))


@register("rule_trace", o.query(
    "SELECT employee_id, '$.and[0]' AS path, 'comparison' AS type, coalesce(employment_type = '1-URGENT', FALSE) AS matched, 0 AS place FROM snap UNION ALL "
    "SELECT employee_id, '$.and[1].not', 'comparison', coalesce(attr_status = 'F', FALSE), 1 FROM snap UNION ALL "
    "SELECT employee_id, '$.and[1]', 'not', NOT coalesce(attr_status = 'F', FALSE), 2 FROM snap UNION ALL "
    "SELECT employee_id, '$', 'and', coalesce(employment_type = '1-URGENT', FALSE) AND NOT coalesce(attr_status = 'F', FALSE), 3 FROM snap", o.snap()))
def rule_trace(spark, d):
    rule = compile_rule(fx.RULES[1]["condition"], F.lit(DAY))
    return Data(spark, d).snap().select("employee_id", F.posexplode(rule.trace).alias("place", "t")).select(
        "employee_id", "t.path", "t.type", "t.matched", "place")


@register("rule_dependencies", "SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{c}', '{t}', '{k}', '{p}', {m})" for v, c, t, k, p, m in (
    ("r-any-v1", "main", "FIELD", "department", "NE", "FALSE"), ("r-urgent-v1", "main", "FIELD", "employment_type", "EQ", "TRUE"),
    ("r-urgent-v1", "main", "ATTRIBUTE", "status", "EQ", "FALSE"), ("r-machinery-v1", "main", "FIELD", "department", "EQ", "TRUE"),
    ("r-machinery-v1", "main", "FIELD", "employment_type", "EQ", "FALSE"), ("r-tenured-v1", "main", "FIELD", "hire_date", "GTE", "FALSE"),
    ("r-tenured-v1", "main", "TIME", "tenure_days", "GTE", "FALSE"), ("r-group-v1", "main", "GROUP", "click", "MEMBER_OF", "TRUE"),
    ("r-group-v1", "main", "ATTRIBUTE", "level", "GT", "FALSE"), ("r-future-v1", "main", "FIELD", "department", "EQ", "TRUE"),
    ("r-ended-v1", "main", "FIELD", "department", "EQ", "TRUE"), ("r-off-v1", "main", "FIELD", "department", "EQ", "TRUE"),
    ("k-place-v1", "perks", "FIELD", "location", "IN", "TRUE"), ("k-manager-v1", "perks", "FIELD", "is_manager", "EQ", "TRUE"),
    ("k-level-v1", "perks", "ATTRIBUTE", "level", "GTE", "FALSE"), ("k-level-v1", "perks", "ATTRIBUTE", "status", "NE", "FALSE"),
    ("k-year-v1", "perks", "TIME", "as_of_date", "LT", "FALSE"), ("k-year-v1", "perks", "FIELD", "hire_date", "LT", "FALSE"))) +
    ") v(version_id, category_id, type, key, operator, mandatory)")
def rule_dependencies(spark, d):
    return impact.dependencies(spark, fx.RULES, DAY).drop("selector")


WON = "SELECT employee_id, category_id, policy_id, candidate_id FROM judged WHERE won"


@register("evaluate_category", o.query(
    "SELECT employee_id, policy_id, candidate_id, source, priority, specificity FROM judged WHERE won AND category_id = 'main'", *o.BASE))
def evaluate_category(spark, d):
    return resolve.winners(Data(spark, d).judged()).where("category_id = 'main'").select(
        "employee_id", "policy_id", "candidate_id", "source", "priority", "specificity")


@register("resolve_single", o.query("SELECT category_id, policy_id, count(*) AS n FROM judged WHERE won AND category_id = 'main' GROUP BY ALL", *o.BASE))
def resolve_single(spark, d):
    return Data(spark, d).assigned().where("category_id = 'main'").groupBy("category_id", "policy_id").agg(F.count("*").alias("n"))


@register("resolve_multiple", o.query("SELECT employee_id, policy_id FROM judged WHERE won AND category_id = 'perks'", *o.BASE))
def resolve_multiple(spark, d):
    return Data(spark, d).assigned().where("category_id = 'perks'").select("employee_id", "policy_id")


@register("resolve_exclude_veto", o.query("SELECT employee_id, candidate_id, reason_lost, won_by FROM judged WHERE c_action = 'EXCLUDE'", *o.BASE))
def resolve_exclude_veto(spark, d):
    return Data(spark, d).judged().where(F.col("reason_lost").isin(resolve.EXCLUDED, resolve.VETOED)).select(
        "employee_id", "candidate_id", "reason_lost", "won_by")


@register("rejected_reasons", o.query(
    "SELECT employee_id, category_id, candidate_id, policy_id, reason_lost, won_by FROM judged WHERE NOT won", *o.BASE))
def rejected_reasons(spark, d):
    return resolve.rejected(Data(spark, d).judged()).select("employee_id", "category_id", "candidate_id", "policy_id", "reason_lost", "won_by")


SCOPES = "(SELECT employee_id, c.category_id FROM {0}, (VALUES ('main'), ('perks')) c(category_id))"


@register("decision_evidence", o.query(
    f"SELECT employee_id, category_id, coalesce(w, '') AS winners, coalesce(r, '') AS rejected FROM {SCOPES.format('snap')} LEFT JOIN "
    "(SELECT employee_id, category_id, string_agg(candidate_id, ',' ORDER BY candidate_id) FILTER (WHERE won) AS w, "
    "string_agg(candidate_id, ',' ORDER BY candidate_id) FILTER (WHERE NOT won) AS r FROM judged GROUP BY ALL) USING (employee_id, category_id)", *o.BASE))
def decision_evidence(spark, d):
    data = Data(spark, d)
    e = resolve.decisions(data.judged(with_trace=True), data.scopes())
    return e.select("employee_id", "category_id", *[F.array_join(F.transform(c, lambda x: x["candidate_id"]), ",").alias(c) for c in ("winners", "rejected")])


@register("decisions_without_candidates", o.query(
    f"SELECT employee_id, category_id FROM {SCOPES.format('snap')} ANTI JOIN judged USING (employee_id, category_id)", *o.BASE))
def decisions_without_candidates(spark, d):
    data = Data(spark, d)
    return resolve.decisions(data.judged(), data.scopes()).where("size(winners) + size(rejected) = 0").select("employee_id", "category_id")


@register("tenant_assignments", o.query(
    "SELECT employee_id, category_id, policy_id FROM judged WHERE won AND employee_id IN (SELECT employee_id FROM ev WHERE company_id = 'c1')", *o.BASE))
def tenant_assignments(spark, d):
    return Data(spark, d, "c1").assigned()


@register("input_fingerprint")
def input_fingerprint(spark, d):
    data = Data(spark, d)
    return evaluate.fingerprint(data.snap(), fx.RULES, data.overrides, "main", "SINGLE", DAY)


@register("next_transition_tenure", o.query(f"SELECT employee_id, hire_date + 730 AS date FROM snap WHERE hire_date + 730 > {o.DAY}", o.snap()))
def next_transition_tenure(spark, d):
    t = evaluate.rule_transitions(Data(spark, d).snap(), [fx.RULES[3]], DAY)
    return t.select("employee_id", "date")


@register("next_transition_calendar", o.query("SELECT employee_id, 'k-year-v1' AS source_id, DATE '2000-01-01' AS date FROM snap UNION ALL "
                                              "SELECT employee_id, 'r-future-v1', DATE '1999-09-01' FROM snap", o.snap()))
def next_transition_calendar(spark, d):
    rules = [r for r in fx.RULES if r["rule_id"] in ("k-year", "r-future")]
    return evaluate.rule_transitions(Data(spark, d).snap(), rules, DAY).select("employee_id", "source_id", "date")


OV_DATES = (f"SELECT employee_id, category_id, CAST(id AS VARCHAR) AS source_id, valid_from AS date FROM ov WHERE NOT revoked AND valid_from > {o.DAY} AND (valid_to IS NULL OR valid_to > {o.DAY}) "
            f"UNION SELECT employee_id, category_id, CAST(id AS VARCHAR), valid_to FROM ov WHERE NOT revoked AND valid_to > {o.DAY}")


@register("override_transitions", o.query(OV_DATES))
def override_transitions(spark, d):
    return evaluate.override_transitions(snapshots.overrides_for(fx.manual_overrides(spark, d), DAY), DAY).select(
        "employee_id", "category_id", "source_id", "date")


@register("next_transition_scope", o.query(
    f"SELECT employee_id, category_id, min(date) AS next_date FROM (SELECT employee_id, category_id, date FROM ({OV_DATES}) UNION ALL "
    f"SELECT employee_id, 'main', hire_date + 730 FROM snap WHERE hire_date + 730 > {o.DAY} UNION ALL SELECT employee_id, 'main', DATE '1999-09-01' FROM snap "
    f"UNION ALL SELECT employee_id, 'perks', DATE '2000-01-01' FROM snap) GROUP BY ALL", o.snap()))
def next_transition_scope(spark, d):
    data = Data(spark, d)
    return evaluate.next_transitions([
        evaluate.rule_transitions(data.snap(), fx.RULES, DAY).select("employee_id", "category_id", "date"),
        evaluate.override_transitions(snapshots.overrides_for(data.overrides, DAY), DAY).select("employee_id", "category_id", "date")])


# Impact: versions that begin in June 1999 are the changes.
JUNE = "valid_from BETWEEN DATE '1999-06-01' AND DATE '1999-06-30'"


def _changes(data: Data) -> DataFrame:
    names = ["employment_type", "location"]
    v = temporal.before_after(data.versions, ["employee_id"], "version", names).where(JUNE)
    return v.select("employee_id", temporal.changed_fields(F.col("before"), F.struct(*names), names).alias("changed_fields"))


@register("impact_employee", o.query(
    "SELECT DISTINCT employee_id, c.category_id FROM (SELECT *, LAG(location) OVER w AS l0, LAG(employment_type) OVER w AS e0 FROM ev "
    "WINDOW w AS (PARTITION BY employee_id ORDER BY version)) v JOIN (VALUES ('main'), ('perks')) c(category_id) ON "
    "(c.category_id = 'main' AND employment_type IS DISTINCT FROM e0) OR (c.category_id = 'perks' AND location IS DISTINCT FROM l0) "
    f"OR (employment_type IS NOT DISTINCT FROM e0 AND location IS NOT DISTINCT FROM l0) WHERE {JUNE}"))
def impact_employee(spark, d):
    return impact.employee_impact(spark, _changes(Data(spark, d)), fx.RULES, list(fx.CATEGORIES), DAY)


@register("impact_group", o.query("SELECT DISTINCT employee_id, 'main' AS category_id FROM gm WHERE group_id = 'click'"))
def impact_group(spark, d):
    return impact.group_impact(spark, fx.group_memberships(spark, d).select("employee_id", "group_id"), fx.RULES, DAY)


@register("impact_rule", o.query("SELECT employee_id, 'main' AS category_id FROM snap WHERE department IN ('MACHINERY', 'BUILDING')", o.snap()))
def impact_rule(spark, d):
    new = all_of(compare("department", "EQ", "BUILDING"), compare("tenure_days", "GT", 10))
    return impact.rule_impact(Data(spark, d).snap(), fx.RULES[2]["condition"], new, "main", DAY)


@register("impact_policy", o.query(
    "SELECT employee_id, category_id FROM judged WHERE won AND policy_id = 'p-urgent' UNION SELECT employee_id, 'main' FROM snap WHERE employment_type = '1-URGENT'", *o.BASE))
def impact_policy(spark, d):
    data = Data(spark, d)
    return impact.policy_impact(data.snap(), data.assigned(), "p-urgent", fx.RULES, DAY)


@register("impact_full", o.query("SELECT employee_id, c.category_id FROM snap, (VALUES ('main'), ('perks')) c(category_id)", o.snap()))
def impact_full(spark, d):
    return impact.full_impact(Data(spark, d).snap(), list(fx.CATEGORIES))


@register("impact_listed", o.query("SELECT employee_id, category_id FROM ov GROUP BY ALL"))
def impact_listed(spark, d):
    events = fx.manual_overrides(spark, d).groupBy((F.col("employee_id") % 8).alias("event_id")).agg(
        F.collect_set(F.struct("employee_id", "category_id")).alias("scopes"))
    return impact.listed_impact(events)


@register("selector_population", o.query("SELECT employee_id FROM snap WHERE list_contains(group_ids, 'click') AND is_manager AND location IN ('NATION_3', 'NATION_11', 'NATION_5', 'NATION_6', 'NATION_8')", o.snap()))
def selector_population(spark, d):
    condition = all_of(group("click"), compare("is_manager", "EQ", True), compare("location", "IN", ["NATION_3", "NATION_11", "NATION_5", "NATION_6", "NATION_8"]), compare("attribute.level", "GT", 2))
    return impact.population(Data(spark, d).snap(), condition, DAY)


DIFF = ("diff AS (SELECT coalesce(a.employee_id, b.employee_id) AS employee_id, coalesce(a.category_id, b.category_id) AS category_id, "
        "coalesce(a.policy_id, b.policy_id) AS policy_id, CASE WHEN a.employee_id IS NULL THEN 'ADDED' WHEN b.employee_id IS NULL THEN 'REMOVED' ELSE 'UNCHANGED' END AS state "
        "FROM (SELECT * FROM judged0 WHERE won) a FULL JOIN (SELECT * FROM judged WHERE won) b ON a.employee_id = b.employee_id AND a.category_id = b.category_id AND a.policy_id = b.policy_id)")


def _diff(data: Data) -> DataFrame:
    return reconcile.difference(data.assigned(EARLIER), data.assigned())


@register("diff_added_removed", o.query("SELECT * FROM diff", *o.BASE, *o.BEFORE, DIFF))
def diff_added_removed(spark, d):
    return _diff(Data(spark, d))


@register("history_close", o.query(
    "SELECT employee_id, category_id, policy_id, DATE '1998-12-31' AS valid_from, CASE WHEN state = 'REMOVED' THEN DATE '1999-06-30' END AS valid_to FROM diff WHERE state <> 'ADDED' "
    "UNION ALL SELECT employee_id, category_id, policy_id, DATE '1999-06-30', NULL FROM diff WHERE state = 'ADDED'", *o.BASE, *o.BEFORE, DIFF))
def history_close(spark, d):
    data = Data(spark, d)
    history = data.assigned(EARLIER).withColumns({"valid_from": F.lit(EARLIER), "valid_to": F.lit(None).cast("date")})
    return reconcile.close_history(history, _diff(data), F.lit(DAY))


@register("reconcile_apply", o.query(
    "SELECT employee_id, category_id, policy_id, CASE WHEN category_id = 'main' THEN category_id ELSE policy_id END AS slot_key, "
    "CASE WHEN state = 'ADDED' THEN 'new' ELSE 'old' END AS decision_id, CASE WHEN state = 'ADDED' THEN DATE '1999-06-30' ELSE DATE '1998-12-31' END AS effective_from "
    "FROM diff WHERE state <> 'REMOVED'", *o.BASE, *o.BEFORE, DIFF))
def reconcile_apply(spark, d):
    data = Data(spark, d)
    slot = F.when(F.col("category_id") == "main", F.col("category_id")).otherwise(F.col("policy_id"))
    current = data.assigned(EARLIER).withColumns({"slot_key": slot, "decision_id": F.lit("old"), "effective_from": F.lit(EARLIER)})
    decided = data.assigned().select("employee_id", "category_id").distinct().withColumn("decision_id", F.lit("new"))
    return reconcile.apply_difference(current, _diff(data), decided, fx.CATEGORIES, F.lit(DAY))


@register("reconcile_idempotent", o.query("SELECT 'UNCHANGED' AS state, count(*) AS n FROM judged WHERE won", *o.BASE))
def reconcile_idempotent(spark, d):
    data = Data(spark, d)
    return reconcile.difference(data.assigned(), data.assigned()).groupBy("state").agg(F.count("*").alias("n"))


@register("decision_reuse", o.query(
    "SELECT employee_id, employee_id % 2 = 0 AS reused FROM snap", o.snap()))
def decision_reuse(spark, d):
    data = Data(spark, d)
    fresh = evaluate.fingerprint(data.snap(), fx.RULES, data.overrides, "main", "SINGLE", DAY).withColumn("as_of", F.lit(DAY))
    known = fresh.where("employee_id % 2 = 0").withColumns({"decision_id": F.concat(F.lit("d"), "employee_id"), "decided_at": F.lit(1)})
    return reconcile.reuse_decisions(known, fresh).select("employee_id", "reused")


@register("transition_replace", o.query(
    f"SELECT employee_id, category_id, source_id, date, FALSE AS processed FROM ({OV_DATES}) UNION ALL "
    f"SELECT employee_id, 'main', CAST(id AS VARCHAR), valid_from, TRUE FROM ov WHERE revoked AND valid_from > {o.DAY}"))
def transition_replace(spark, d):
    ov = fx.manual_overrides(spark, d)
    fresh = evaluate.override_transitions(snapshots.overrides_for(ov, DAY), DAY)
    old = ov.where(F.col("revoked") & (F.col("valid_from") > F.lit(DAY))).select(
        "employee_id", "category_id", F.lit("OVERRIDE").alias("source"), F.col("id").cast("string").alias("source_id"), F.col("valid_from").alias("date"))
    scheduled = old.withColumn("processed", F.lit(True)).unionByName(old.withColumns({"date": F.date_add("date", 1), "processed": F.lit(False)}))
    scopes = ov.select("employee_id", "category_id").distinct()
    return reconcile.replace_transitions(scheduled, fresh, scopes, F.lit(DAY)).select("employee_id", "category_id", "source_id", "date", "processed")


def _summary(after_rules) -> tuple:
    return (*o.BASE, o.cand(o.DAY, "cand1", "snap1", rules=after_rules), o.judged("judged1", "cand1"))


CHANGE = ("SELECT employee_id, category_id, count(*) FILTER (WHERE h0 IS NULL) AS added, count(*) FILTER (WHERE h1 IS NULL) AS removed, "
          "count(*) FILTER (WHERE h0 = 1 AND h1 = 1) AS unchanged, count(*) FILTER (WHERE h0 IS NULL) > 0 AND count(*) FILTER (WHERE h1 IS NULL) > 0 AS replaced FROM "
          "(SELECT employee_id, category_id, policy_id, 1 AS h0 FROM judged WHERE won) FULL JOIN (SELECT employee_id, category_id, policy_id, 1 AS h1 FROM judged1 WHERE won) "
          "USING (employee_id, category_id, policy_id) GROUP BY ALL")


@register("preview_employee", o.query(
    f"SELECT * FROM ({CHANGE}) WHERE employee_id = 7", *o.BASE, "snap1 AS (SELECT * REPLACE (CASE WHEN employee_id = 7 THEN 'MACHINERY' ELSE department END AS department, "
    "CASE WHEN employee_id = 7 THEN '2-HIGH' ELSE employment_type END AS employment_type) FROM snap)", o.cand(o.DAY, "cand1", "snap1"), o.judged("judged1", "cand1")))
def preview_employee(spark, d):
    data = Data(spark, d)
    proposed = snapshots.with_proposed_facts(data.snap(), 7, {"department": "MACHINERY", "employment_type": "2-HIGH"})
    return preview.preview_facts(data.snap(), proposed, fx.RULES, data.overrides, fx.CATEGORIES, DAY, 7)


@register("preview_override", o.query(
    f"SELECT * FROM ({CHANGE}) WHERE employee_id = 7", *o.BASE, "ov1 AS (SELECT * FROM ov UNION ALL SELECT 999999999, 7, 'main', 'p-machinery', 'ASSIGN', 1000, DATE '1999-01-01', NULL, FALSE, 'x', 'c1')",
    o.cand(o.DAY, "cand1", "snap", "ov1"), o.judged("judged1", "cand1")))
def preview_override(spark, d):
    data = Data(spark, d)
    extra = spark.createDataFrame([(999999999, 7, "main", "p-machinery", "ASSIGN", 1000, datetime.date(1999, 1, 1), None, False, "x", "c1")], data.overrides.schema)
    return preview.preview_override(data.snap(), fx.RULES, data.overrides, extra, fx.CATEGORIES, DAY, 7)


RULES_AFTER = [r for r in o.RULES if r[0] != "r-tenured-v1"] + [("r-tenured-v2", "main", "p-tenured", 60, 1, "coalesce(tenure >= 1000, FALSE)")]
PROPOSED = fx.RULES[3] | {"version_id": "r-tenured-v2", "priority": 60, "condition": compare("tenure_days", "GTE", 1000)}


@register("preview_rule_totals", o.query(
    "SELECT (SELECT count(*) FROM snap) AS population, count(*) FILTER (WHERE added > 0 OR removed > 0) AS affected, "
    "(SELECT count(*) FROM snap) - count(*) FILTER (WHERE added > 0 OR removed > 0) AS unaffected, CAST(sum(added) AS BIGINT) AS additions, "
    "CAST(sum(removed) AS BIGINT) AS removals, count(*) FILTER (WHERE replaced) AS replacements, CAST(sum(unchanged) AS BIGINT) AS unchanged "
    f"FROM ({CHANGE}) WHERE category_id = 'main'", *o.BASE, o.cand(o.DAY, "cand1", "snap", rules=RULES_AFTER), o.judged("judged1", "cand1")))
def preview_rule_totals(spark, d):
    data = Data(spark, d)
    return preview.totals(preview.preview_rule(data.snap(), fx.RULES, PROPOSED, data.overrides, fx.CATEGORIES, DAY))


@register("preview_rule_examples", o.query(
    f"SELECT employee_id, added, removed FROM ({CHANGE}) WHERE category_id = 'main' AND (added > 0 OR removed > 0) ORDER BY employee_id LIMIT 25",
    *o.BASE, o.cand(o.DAY, "cand1", "snap", rules=RULES_AFTER), o.judged("judged1", "cand1")))
def preview_rule_examples(spark, d):
    data = Data(spark, d)
    return preview.examples(preview.preview_rule(data.snap(), fx.RULES, PROPOSED, data.overrides, fx.CATEGORIES, DAY), 25).select("employee_id", "added", "removed")


@register("assignments_now", o.query(f"SELECT j.employee_id, j.category_id, j.policy_id, 'Policy ' || policy_id AS name FROM ({WON}) j", *o.BASE))
def assignments_now(spark, d):
    return Data(spark, d).assigned().join(F.broadcast(fx.policies(spark).select("policy_id", "name")), "policy_id").select(
        "employee_id", "category_id", "policy_id", "name")


def _policy_versions(spark) -> DataFrame:
    date = datetime.date
    return fx.policies(spark).select("policy_id", F.explode(F.array(
        F.struct(F.lit(1).alias("version"), F.lit(date(1990, 1, 1)).alias("valid_from"), F.lit(date(1999, 1, 1)).alias("valid_to"), F.lit("Old ").alias("prefix")),
        F.struct(F.lit(2).alias("version"), F.lit(date(1999, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit("New ").alias("prefix")))).alias("v")).select(
        "policy_id", "v.version", "v.valid_from", "v.valid_to", F.concat("v.prefix", "policy_id").alias("name"))


@register("assignments_as_of", o.query(
    "SELECT employee_id, category_id, policy_id, 'New ' || policy_id AS name FROM diff WHERE state <> 'REMOVED'", *o.BASE, *o.BEFORE, DIFF))
def assignments_as_of(spark, d):
    return explain.assignments_as_of(history_close(spark, d), _policy_versions(spark), DAY).select("employee_id", "category_id", "policy_id", "name")


@register("policy_name_at_start", o.query(
    "SELECT employee_id, policy_id, CASE WHEN state = 'ADDED' THEN 'New ' ELSE 'Old ' END || policy_id AS policy_name FROM diff", *o.BASE, *o.BEFORE, DIFF))
def policy_name_at_start(spark, d):
    return explain.name_at_start(history_close(spark, d), _policy_versions(spark)).select("employee_id", "policy_id", "policy_name")


def _decisions(data: Data) -> DataFrame:
    out = None
    for n, day in enumerate((EARLIER, DAY)):
        e = resolve.decisions(data.judged(day), data.scopes(day)).withColumns({"as_of": F.lit(day), "decided_at": F.lit(n), "decision_id": F.lit(f"d{n}")})
        out = e if out is None else out.unionByName(e)
    return out


@register("explain_latest_decision", o.query(
    "SELECT employee_id, max(d) AS decision_id FROM (SELECT employee_id, 'd0' AS d FROM judged0 WHERE won AND policy_id = 'p-tenured' UNION ALL "
    "SELECT employee_id, 'd1' FROM judged WHERE won AND policy_id = 'p-tenured') GROUP BY employee_id", *o.BASE, *o.BEFORE))
def explain_latest_decision(spark, d):
    return explain.latest_decision_with(_decisions(Data(spark, d)), F.lit("p-tenured"), F.lit(DAY)).select("employee_id", "decision_id")


@register("explanation", o.query(
    "SELECT w.employee_id, w.category_id, w.policy_id, 'Policy ' || w.policy_id || ' holds by ' || CASE WHEN source = 'MANUAL' THEN 'a manual control' ELSE 'a rule' END "
    "|| ' at priority ' || priority || '; rejected: ' || coalesce(n, 0) AS summary FROM (SELECT * FROM judged WHERE won) w LEFT JOIN "
    "(SELECT employee_id, category_id, count(*) AS n FROM judged WHERE NOT won GROUP BY ALL) l USING (employee_id, category_id)", *o.BASE))
def explanation(spark, d):
    judged = Data(spark, d).judged()
    return explain.explanation(resolve.winners(judged).select("employee_id", "category_id", "policy_id"), judged, fx.policies(spark)).select(
        "employee_id", "category_id", "policy_id", "summary")


@register("audit_assignment_changes", o.query(
    "SELECT employee_id, category_id, n.w AS winners, p.w AS previous FROM "
    f"(SELECT * FROM {SCOPES.format('snap')} LEFT JOIN (SELECT employee_id, category_id, string_agg(policy_id, ',' ORDER BY candidate_id) AS w FROM judged WHERE won GROUP BY ALL) USING (employee_id, category_id)) n LEFT JOIN "
    f"(SELECT *, TRUE AS there FROM {SCOPES.format('snap0')} LEFT JOIN (SELECT employee_id, category_id, string_agg(policy_id, ',' ORDER BY candidate_id) AS w FROM judged0 WHERE won GROUP BY ALL) USING (employee_id, category_id)) p "
    "USING (employee_id, category_id) WHERE there IS NULL OR n.w IS DISTINCT FROM p.w", *o.BASE, *o.BEFORE))
def audit_assignment_changes(spark, d):
    ids = _decisions(Data(spark, d)).withColumn("winners", F.transform("winners", lambda w: w["policy_id"]))
    names = explain.winner_changes(ids).where("decided_at = 1")
    text = [F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("winners", "previous")]
    return names.select("employee_id", "category_id", *text)
