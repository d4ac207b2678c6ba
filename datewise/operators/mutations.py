"""Source mutations: sets of requests become new tables, events for the queue, and refusals with a code.

Every table and request carries company_id, and every join is on it. Each
function takes whole tables, so a set of thousands of requests is one plan; a
set holds one request per entity. Tables come back as new DataFrames, to be
written as a generation; nothing is changed in place. A request that changes
nothing emits no event.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import compile_rule
from ..functions.temporal import active_on

# The facts of an employee version that a request may set, in the order of the table.
FACTS = ("display_name", "email", "location", "department", "employment_type", "is_manager", "hire_date", "attributes_json")
#: Columns of an event row, as the queue takes them.
EVENT = ("company_id", "event_type", "scope", "payload", "dedupe_key", "priority", "available_at")
#: Queue priority of override events and of a full reconciliation that was asked for.
OVERRIDE_PRIORITY, FULL_PRIORITY = 20, -10


@dataclass
class Outcome:
    """Tables that changed, by name; events; and refused requests with their `code`."""

    tables: dict[str, DataFrame]
    events: DataFrame | None = None
    refused: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def event(rows: DataFrame, kind: str, scope: str, key: Column, payload: list[Column], available: Column, priority: int = 0) -> DataFrame:
    """One event a row; the key makes a replay of the same request a duplicate."""
    body = F.to_json(F.struct(*payload)) if payload else F.lit("{}")
    return rows.select("company_id", F.lit(kind).alias("event_type"), F.lit(scope).alias("scope"), body.alias("payload"),
                       key.alias("dedupe_key"), F.lit(priority).alias("priority"), available.cast("date").alias("available_at"))


def _key(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def checked(requests: DataFrame, checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): the first check that holds gives the refusal's code."""
    code = F.lit(None).cast("string")
    for holds, name in reversed(checks):
        code = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(code)
    marked = requests.withColumn("code", code)
    return marked.where("code IS NULL").drop("code"), marked.where("code IS NOT NULL")


def _known(requests: DataFrame, table: DataFrame, key: dict[str, str], flag: str) -> DataFrame:
    """Whether the referenced row exists in the request's company: an equi-join on company and id, not a cross join."""
    ids = table.select("company_id", *[F.col(there).alias(here) for here, there in key.items()]).distinct()
    return requests.join(ids.withColumn(flag, F.lit(True)), ["company_id", *key], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _latest(versions: DataFrame, key: str) -> DataFrame:
    """The newest version of each entity, by aggregation."""
    return versions.groupBy("company_id", key).agg(F.max_by(F.struct(*versions.columns), "version").alias("v")).select("v.*")


def _close(versions: DataFrame, ended: DataFrame, key: list[str]) -> DataFrame:
    """`ended` has the key and `ends_at`: those rows get that end."""
    both = versions.join(ended.select("company_id", *key, "ends_at"), ["company_id", *key], "left")
    return both.withColumn("valid_to", F.coalesce("ends_at", "valid_to")).select(*versions.columns)


def _add(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows put under a table's columns; columns they lack are null."""
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]), allowMissingColumns=True)


def insert_named(table: DataFrame, requests: DataFrame, unique: str, references: list[tuple[DataFrame, dict[str, str]]] = ()) -> Outcome:
    """M-01, M-04, M-08, M-10: new rows whose `unique` column is free in the company and whose references exist."""
    rows = _known(requests, table, {unique: unique}, "taken")
    checks = [(F.col("taken"), "CONFLICT")]
    flags = ["taken"]
    for n, (other, key) in enumerate(references):
        rows = _known(rows, other, key, f"there_{n}")
        checks.append((~F.col(f"there_{n}"), "NOT_FOUND"))
        flags.append(f"there_{n}")
    good, bad = checked(rows, checks)
    return Outcome({"table": _add(table, good.drop(*flags))}, refused=bad.drop(*flags))


def rename(table: DataFrame, requests: DataFrame, key: str, columns: tuple[str, ...], immutable: tuple[str, ...] = ()) -> Outcome:
    """M-05, M-09: set `columns` where the request gives a value; a changed value of an immutable column is refused."""
    held = [*columns, *immutable]
    old = table.select("company_id", key, *[F.col(c).alias(f"old_{c}") for c in held], F.lit(True).alias("there"))
    rows = requests.join(old, ["company_id", key], "left")
    moved = F.lit(False)
    for c in immutable:
        moved = moved | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}")))
    good, bad = checked(rows, [(F.col("there").isNull(), "NOT_FOUND"), (moved, "IMMUTABLE")])
    new = good.select("company_id", key, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = table.join(new, ["company_id", key], "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns})
    return Outcome({"table": out.select(*table.columns)}, refused=bad.select(*requests.columns, "code"))


def create_employees(employees: DataFrame, versions: DataFrame, memberships: DataFrame, groups: DataFrame,
                     requests: DataFrame, today: datetime.date) -> Outcome:
    """M-02: identity, version 1 and memberships. `requests` has employee_id, external_id, FACTS, effective_from, group_ids."""
    start = F.coalesce("effective_from", F.lit(today))
    wanted = requests.select("company_id", "employee_id", F.explode(F.array_distinct("group_ids")).alias("group_id"))
    unknown = wanted.join(groups.select("company_id", "group_id"), ["company_id", "group_id"], "left_anti").select(
        "company_id", "employee_id", F.lit(True).alias("strange")).distinct()
    rows = _known(requests, employees, {"external_id": "external_id"}, "taken").join(unknown, ["company_id", "employee_id"], "left")
    good, bad = checked(rows, [(F.col("strange"), "INVALID_REFERENCE"), (F.col("taken"), "CONFLICT")])
    good = good.withColumns({"valid_from": start, "valid_to": F.lit(None).cast("date"), "version": F.lit(1),
                             "changed_fields": F.array(F.lit("created")), "is_manager": F.coalesce("is_manager", F.lit(False)),
                             "attributes_json": F.coalesce("attributes_json", F.lit("{}"))})
    members = good.select("company_id", "employee_id", "valid_from", "valid_to", F.explode(F.array_distinct("group_ids")).alias("group_id"))
    return Outcome(
        {"employees": _add(employees, good), "versions": _add(versions, good), "memberships": _add(memberships, members)},
        event(good, "EMPLOYEE_CREATED", "EMPLOYEE", _key("employee:", F.col("employee_id"), ":version:1"), [F.col("employee_id").alias("employeeId")],
              F.col("valid_from")), bad.select(*requests.columns, "code"))


def changed_facts(old: str, new: str) -> Column:
    """Sorted names of facts that differ between two structs; attributes key by key, as `attributes.<key>`."""
    plain = F.filter(F.array(*[F.when(~F.col(f"{old}.{n}").eqNullSafe(F.col(f"{new}.{n}")), F.lit(n))
                               for n in FACTS if n != "attributes_json"]), lambda x: x.isNotNull())

    def values(side):
        return F.transform_values(F.from_json(F.coalesce(F.col(f"{side}.attributes_json"), F.lit("{}")), "map<string,variant>"),
                                  lambda _, v: F.to_json(v))

    a, b = values(old), values(new)
    keys = F.filter(F.array_union(F.map_keys(a), F.map_keys(b)), lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    return F.array_sort(F.concat(plain, F.transform(keys, lambda k: F.concat(F.lit("attributes."), k))))


def patch_employees(versions: DataFrame, memberships: DataFrame, groups: DataFrame, requests: DataFrame, today: datetime.date) -> Outcome:
    """M-03: close the current version and append the next, with its changed fields; open and close memberships.

    `requests` has employee_id, effective_from, `given` (names of the facts that
    are set, null values included), FACTS, and group_ids (null: left alone).
    """
    current = _latest(versions, "employee_id")
    start = F.coalesce("effective_from", F.lit(today))
    asked = requests.withColumn("effective_from", start)
    old = current.select("company_id", "employee_id", F.col("version").alias("old_version"), F.col("valid_from").alias("old_from"),
                         F.struct(*FACTS).alias("old"))
    wanted = asked.select("company_id", "employee_id", F.explode("group_ids").alias("group_id")).distinct()
    strange = wanted.join(groups.select("company_id", "group_id"), ["company_id", "group_id"], "left_anti").select(
        "company_id", "employee_id", F.lit(True).alias("strange")).distinct()
    rows = asked.join(old, ["company_id", "employee_id"], "left").join(strange, ["company_id", "employee_id"], "left")
    good, bad = checked(rows, [
        (F.col("effective_from") < F.lit(today), "BACKDATED_MUTATION"), (F.col("old").isNull(), "NOT_FOUND"),
        (F.col("effective_from") < F.col("old_from"), "CONFLICT"), (F.col("strange"), "INVALID_REFERENCE")])
    # is_manager, display name and attributes keep their value when given as null.
    kept = ("display_name", "is_manager", "attributes_json")
    new = F.struct(*[(F.coalesce(F.when(F.array_contains("given", n), F.col(n)), F.col(f"old.{n}")) if n in kept else
                      F.when(F.array_contains("given", n), F.col(n)).otherwise(F.col(f"old.{n}"))).alias(n) for n in FACTS])
    good = good.withColumn("new", new).withColumn("changed_fields", changed_facts("old", "new"))
    moved = good.where(F.size("changed_fields") > 0)
    added = moved.select("company_id", "employee_id", (F.col("old_version") + 1).alias("version"), F.col("effective_from").alias("valid_from"),
                         F.lit(None).cast("date").alias("valid_to"), "new.*", "changed_fields")
    closed = _close(versions, moved.select("company_id", "employee_id", F.col("old_version").alias("version"), F.col("effective_from").alias("ends_at")),
                    ["employee_id", "version"])
    extra = [c for c in versions.columns if c not in added.columns]
    added = added.join(current.select("company_id", "employee_id", *extra), ["company_id", "employee_id"])
    events = event(moved, "EMPLOYEE_UPDATED", "EMPLOYEE", _key("employee:", F.col("employee_id"), ":version:", F.col("old_version") + 1),
                   [F.col("employee_id").alias("employeeId"), F.col("changed_fields").alias("changedFields")], F.col("effective_from"))
    # Memberships: those active on the date against the wanted ones.
    with_groups = good.where("group_ids IS NOT NULL").select("company_id", "employee_id", "effective_from", "group_ids")
    have = memberships.join(with_groups.select("company_id", "employee_id", "effective_from"), ["company_id", "employee_id"]).where(
        active_on(F.col("effective_from"))).select("company_id", "employee_id", "group_id", "effective_from", F.lit(True).alias("have"))
    want = with_groups.select("company_id", "employee_id", "effective_from", F.explode(F.array_distinct("group_ids")).alias("group_id")).withColumn(
        "want", F.lit(True))
    both = have.join(want, ["company_id", "employee_id", "group_id", "effective_from"], "full")
    gained, lost = both.where("have IS NULL"), both.where("want IS NULL")
    out = _change_members(memberships, gained, lost)
    return Outcome({"versions": _add(closed, added), "memberships": out.tables["memberships"]}, events.unionByName(out.events),
                   bad.select(*requests.columns, "code"))


def _change_members(memberships: DataFrame, gained: DataFrame, lost: DataFrame) -> Outcome:
    """Open `gained` and close `lost` memberships on their effective_from, with one event each."""
    ends = lost.select("company_id", "employee_id", "group_id", F.col("effective_from").alias("ends_at"))
    both = memberships.join(ends, ["company_id", "employee_id", "group_id"], "left")
    hit = F.col("ends_at").isNotNull() & active_on(F.col("ends_at"))
    closed = both.withColumn("valid_to", F.when(hit, F.col("ends_at")).otherwise(F.col("valid_to"))).select(*memberships.columns)
    opened = gained.select("company_id", "employee_id", "group_id", F.col("effective_from").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    member = _key("membership:", F.col("group_id"), ":", F.col("employee_id"), ":", F.col("effective_from").cast("string"))
    payload = [F.col("employee_id").alias("employeeId"), F.col("group_id").alias("groupId")]
    events = event(gained, "GROUP_MEMBERSHIP_ADDED", "GROUP", _key(member, ":added"), payload, F.col("effective_from")).unionByName(
        event(lost, "GROUP_MEMBERSHIP_REMOVED", "GROUP", _key(member, ":removed"), payload, F.col("effective_from")))
    return Outcome({"memberships": _add(closed, opened)}, events)


def add_members(memberships: DataFrame, groups: DataFrame, versions: DataFrame, requests: DataFrame, today: datetime.date) -> Outcome:
    """M-06: the employee must exist by then and not be a member on the date already."""
    asked = requests.withColumn("effective_from", F.coalesce("effective_from", F.lit(today)))
    born = versions.groupBy("company_id", "employee_id").agg(F.min("valid_from").alias("born"))
    rows = _known(asked, groups, {"group_id": "group_id"}, "there").join(born, ["company_id", "employee_id"], "left")
    held = memberships.join(asked.select("company_id", "employee_id", "group_id", "effective_from"), ["company_id", "employee_id", "group_id"]).where(
        F.col("valid_to").isNull() | (F.col("valid_to") > F.col("effective_from"))).select(
        "company_id", "employee_id", "group_id", F.lit(True).alias("held")).distinct()
    rows = rows.join(held, ["company_id", "employee_id", "group_id"], "left")
    good, bad = checked(rows, [
        (F.col("effective_from") < F.lit(today), "BACKDATED_MUTATION"), (~F.col("there") | F.col("born").isNull(), "NOT_FOUND"),
        (F.col("effective_from") < F.col("born"), "INVALID_EFFECTIVE_DATE"), (F.col("held"), "CONFLICT")])
    out = _change_members(memberships, good, good.limit(0))
    return Outcome(out.tables, out.events, bad.select(*requests.columns, "code"))


def remove_members(memberships: DataFrame, requests: DataFrame, today: datetime.date) -> Outcome:
    """M-07: close the membership that is active on the date."""
    asked = requests.withColumn("effective_from", F.coalesce("effective_from", F.lit(today)))
    held = memberships.join(asked.select("company_id", "employee_id", "group_id", "effective_from"), ["company_id", "employee_id", "group_id"]).where(
        active_on(F.col("effective_from"))).select("company_id", "employee_id", "group_id", F.lit(True).alias("held")).distinct()
    rows = asked.join(held, ["company_id", "employee_id", "group_id"], "left")
    good, bad = checked(rows, [(F.col("effective_from") < F.lit(today), "BACKDATED_MUTATION"), (F.col("held").isNull(), "NOT_FOUND")])
    out = _change_members(memberships, good.limit(0), good)
    return Outcome(out.tables, out.events, bad.select(*requests.columns, "code"))


def publish_policy_versions(versions: DataFrame, requests: DataFrame, today: datetime.date) -> Outcome:
    """M-11: close the current version of a policy and append the next."""
    old = _latest(versions, "policy_id").select("company_id", "policy_id", F.col("version").alias("old_version"), F.col("valid_from").alias("old_from"))
    rows = requests.join(old, ["company_id", "policy_id"], "left")
    good, bad = checked(rows, [
        (F.col("effective_from") < F.lit(today), "BACKDATED_MUTATION"), (F.col("old_version").isNull(), "NOT_FOUND"),
        (F.col("effective_from") < F.col("old_from"), "CONFLICT")])
    closed = _close(versions, good.select("company_id", "policy_id", F.col("old_version").alias("version"), F.col("effective_from").alias("ends_at")),
                    ["policy_id", "version"])
    added = good.withColumns({"version": F.col("old_version") + 1, "valid_from": F.col("effective_from"), "valid_to": F.lit(None).cast("date"),
                              "enabled": F.coalesce("enabled", F.lit(True))})
    events = event(good, "POLICY_VERSION_PUBLISHED", "POLICY", _key("policy:", F.col("policy_id"), ":version:", F.col("old_version") + 1),
                   [F.col("policy_id").alias("policyId")], F.col("effective_from"))
    return Outcome({"versions": _add(closed, added)}, events, bad.select(*requests.columns, "code"))


def dependency_rows(conditions: dict[str, dict], as_of: datetime.date) -> list[tuple]:
    """(version id, type, key, operator, selector, mandatory) of each new rule version; compiled on the driver, which validates."""
    return [(version, d.type, d.key, d.operator, d.selector, d.mandatory)
            for version, condition in sorted(conditions.items()) for d in compile_rule(condition, F.lit(as_of)).dependencies]


def draft_rule_versions(versions: DataFrame, policies: DataFrame, requests: DataFrame) -> Outcome:
    """M-12, M-13: the next DRAFT version of each rule, 1 for a new one; a rule cannot move to another category.

    `requests` has rule_id, version_id, policy_id, priority, enabled, valid_from, valid_to, condition.
    """
    own = policies.select("company_id", "policy_id", "category_id")
    first = versions.select("company_id", "rule_id", "policy_id", "version").join(own, ["company_id", "policy_id"]).groupBy("company_id", "rule_id").agg(
        F.max("version").alias("last"), F.min_by("category_id", "version").alias("old_category"))
    rows = requests.join(own, ["company_id", "policy_id"], "left").join(first, ["company_id", "rule_id"], "left")
    good, bad = checked(rows, [
        (F.col("category_id").isNull(), "NOT_FOUND"), (F.col("old_category") != F.col("category_id"), "RULE_CATEGORY_IMMUTABLE"),
        (F.col("valid_to") <= F.col("valid_from"), "VALIDATION_ERROR")])
    added = good.withColumns({"version": F.coalesce("last", F.lit(0)) + 1, "status": F.lit("DRAFT")})
    return Outcome({"versions": _add(versions, added)}, refused=bad.select(*requests.columns, "code"))


def publish_rule_versions(versions: DataFrame, requests: DataFrame, today: datetime.date) -> Outcome:
    """M-14: publish drafts; the published version before ends where the new one begins. Published ones are left alone.

    `requests` has rule_id and version_id.
    """
    published = versions.where("status = 'PUBLISHED'")
    current = _latest(published, "rule_id").select("company_id", "rule_id", F.col("version_id").alias("old_id"), F.col("valid_from").alias("old_from"))
    draft = versions.select("company_id", "rule_id", "version_id", "version", "valid_from", "status")
    rows = requests.join(draft, ["company_id", "rule_id", "version_id"], "left").join(current, ["company_id", "rule_id"], "left")
    again, rest = rows.where("status = 'PUBLISHED'"), rows.where("status IS NULL OR status <> 'PUBLISHED'")
    good, bad = checked(rest, [
        (F.col("status").isNull(), "NOT_FOUND"), (F.col("status") != "DRAFT", "CONFLICT"),
        (F.col("valid_from") < F.lit(today), "BACKDATED_MUTATION"), (F.col("valid_from") < F.col("old_from"), "CONFLICT")])
    closed = _close(versions, good.where("old_id IS NOT NULL").select("company_id", F.col("old_id").alias("version_id"), F.col("valid_from").alias("ends_at")),
                    ["version_id"])
    hit = good.select("company_id", "version_id", F.lit(True).alias("hit"))
    out = closed.join(hit, ["company_id", "version_id"], "left").withColumn(
        "status", F.when(F.col("hit"), "PUBLISHED").otherwise(F.col("status"))).select(*versions.columns)
    events = event(good, "RULE_VERSION_PUBLISHED", "RULE", _key("rule:", F.col("rule_id"), ":version:", F.col("version"), ":published"),
                   [F.col("version_id").alias("ruleVersionId"), F.col("old_id").alias("previousRuleVersionId")], F.col("valid_from"))
    return Outcome({"versions": out}, events, bad.select(*requests.columns, "code"), {"unchanged": again})


def create_overrides(overrides: DataFrame, policies: DataFrame, versions: DataFrame, requests: DataFrame, today: datetime.date) -> Outcome:
    """M-15: the employee must exist by then. `requests` has id, employee_id, policy_id, action, priority, reason, valid_from, valid_to."""
    asked = requests.withColumn("valid_from", F.coalesce("valid_from", F.lit(today)))
    born = versions.groupBy("company_id", "employee_id").agg(F.min("valid_from").alias("born"))
    rows = asked.join(policies.select("company_id", "policy_id", "category_id"), ["company_id", "policy_id"], "left").join(
        born, ["company_id", "employee_id"], "left")
    good, bad = checked(rows, [
        (F.col("valid_from") < F.lit(today), "BACKDATED_MUTATION"), (F.col("valid_to") <= F.col("valid_from"), "VALIDATION_ERROR"),
        (F.col("category_id").isNull() | F.col("born").isNull(), "NOT_FOUND"), (F.col("valid_from") < F.col("born"), "INVALID_EFFECTIVE_DATE")])
    events = event(good, "MANUAL_OVERRIDE_CREATED", "OVERRIDE", _key("override:", F.col("id"), ":created"),
                   [F.col("employee_id").alias("employeeId"), F.col("category_id").alias("categoryId")], F.col("valid_from"), OVERRIDE_PRIORITY)
    return Outcome({"overrides": _add(overrides, good.withColumn("revoked", F.lit(False)))}, events, bad.select(*requests.columns, "code"))


def revoke_overrides(overrides: DataFrame, requests: DataFrame, today: datetime.date) -> Outcome:
    """M-16: mark as revoked and shorten the interval to today where it has begun; revoked ones are left alone."""
    asked = requests.select("company_id", "id", F.lit(True).alias("asked"))
    both = overrides.join(asked, ["company_id", "id"], "left")
    hit = F.coalesce("asked", F.lit(False)) & ~F.col("revoked")
    day = F.lit(today)
    end = F.when(day > F.col("valid_from"), F.least(F.coalesce("valid_to", day), day)).otherwise(F.col("valid_to"))
    out = both.withColumns({"valid_to": F.when(hit, end).otherwise(F.col("valid_to")), "revoked": F.col("revoked") | hit})
    rows = both.where(hit)
    events = event(rows, "MANUAL_OVERRIDE_REVOKED", "OVERRIDE", _key("override:", F.col("id"), ":revoked"),
                   [F.col("employee_id").alias("employeeId"), F.col("category_id").alias("categoryId")], day, OVERRIDE_PRIORITY)
    _, bad = checked(_known(requests, overrides, {"id": "id"}, "there"), [(~F.col("there"), "NOT_FOUND")])
    return Outcome({"overrides": out.select(*overrides.columns)}, events, bad.select(*requests.columns, "code"))


def trigger_full(requests: DataFrame, today: datetime.date) -> Outcome:
    """M-17: a full reconciliation of each company asked for. `requests` has company_id and request_id."""
    return Outcome({}, event(requests, "MANUAL_FULL_RECONCILIATION", "FULL", _key("full:", F.col("request_id")), [], F.lit(today), FULL_PRIORITY))


def append_events(queue: DataFrame, events: DataFrame) -> DataFrame:
    """ST-01: the queue with the new events; of rows of one company and key the one already queued stays."""
    new = events.join(queue.select("company_id", "dedupe_key"), ["company_id", "dedupe_key"], "left_anti")
    first = Window.partitionBy("company_id", "dedupe_key").orderBy("event_type", "payload")
    return queue.unionByName(new.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn"), allowMissingColumns=True)
