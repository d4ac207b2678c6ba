"""Evaluation: rules and overrides over a snapshot become candidates and transition dates."""

from __future__ import annotations

import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CompiledRule, RuleCompiler, content_hash, next_date
from ..functions.temporal import active_on

#: Specificity of a manual override, above that of any rule.
MANUAL_SPECIFICITY = 2 ** 53 - 1
#: Rules of one projection; more would make generated methods too large to compile.
RULES_PER_PROJECTION = 25

CANDIDATE = ["employee_id", "category_id", "candidate_id", "policy_id", "source", "action", "priority", "specificity", "reason", "trace"]


def _live(rule: dict, day: datetime.date) -> bool:
    """Whether a rule can match on the date; decided on the driver, as the date is a literal."""
    start = datetime.date.fromisoformat(rule["valid_from"])
    end = rule["valid_to"] and datetime.date.fromisoformat(rule["valid_to"])
    return rule["enabled"] and rule["policy_enabled"] and start <= day and (not end or end > day)


def _loaded(rule: dict, day: datetime.date) -> bool:
    return not rule["valid_to"] or datetime.date.fromisoformat(rule["valid_to"]) > day


@lru_cache(maxsize=16)
def _compiler(as_of: datetime.date) -> RuleCompiler:
    """Compiled rules of a date; their Columns hold the date as a literal."""
    return RuleCompiler(F.lit(as_of).cast("date"))


def compiled(rules: list[dict], as_of: datetime.date) -> list[tuple[dict, CompiledRule]]:
    """Rules that have not ended, by rule id; a version that comes back with another condition is an error."""
    compiler = _compiler(as_of)
    return [(r, compiler.get(r["version_id"], r["condition"], r.get("content_hash") or content_hash(r["condition"])))
            for r in sorted(rules, key=lambda r: r["rule_id"]) if _loaded(r, as_of)]


def rule_candidates(snap: DataFrame, rules: list[dict], as_of: datetime.date, with_trace: bool = False) -> DataFrame:
    """One row per employee and matching rule.

    All rules of a chunk are one array column over one scan; an employee's
    matches are exploded from it, so there is no employee x rule join. Traces
    are built only for what matched.
    """
    live = [(r, c) for r, c in compiled(rules, as_of) if _live(r, as_of)]
    out = None
    for at in range(0, max(1, len(live)), RULES_PER_PROJECTION):
        entries = [F.when(c.predicate, F.struct(
            F.lit(r["category_id"]).alias("category_id"), F.lit(f"rule:{r['version_id']}").alias("candidate_id"),
            F.lit(r["policy_id"]).alias("policy_id"), F.lit("RULE").alias("source"), F.lit("ASSIGN").alias("action"),
            F.lit(r["priority"]).alias("priority"), F.lit(c.specificity).cast("long").alias("specificity"),
            F.lit(None).cast("string").alias("reason"),
            (F.to_json(c.trace) if with_trace else F.lit(None).cast("string")).alias("trace")))
            for r, c in live[at:at + RULES_PER_PROJECTION]]
        if not entries:
            entries = [F.lit(None).cast("struct<category_id:string,candidate_id:string,policy_id:string,source:string,"
                                         "action:string,priority:int,specificity:bigint,reason:string,trace:string>")]
        part = snap.select("employee_id", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("m")).select(
            "employee_id", "m.*")
        out = part if out is None else out.unionByName(part)
    return out


def override_candidates(overrides: DataFrame, as_of: datetime.date) -> DataFrame:
    return overrides.where(~F.col("revoked") & active_on(as_of)).select(
        "employee_id", "category_id", F.concat(F.lit("manual:"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("candidate_id"),
        "policy_id", F.lit("MANUAL").alias("source"), "action", "priority",
        F.lit(MANUAL_SPECIFICITY).cast("long").alias("specificity"),
        F.col("reason") if "reason" in overrides.columns else F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("trace"))


def candidates(snap: DataFrame, rules: list[dict], overrides: DataFrame, as_of: datetime.date, with_trace: bool = False) -> DataFrame:
    """Rule matches and active overrides of employees in the snapshot."""
    manual = override_candidates(overrides, as_of).join(snap.select("employee_id"), "employee_id", "left_semi")
    return rule_candidates(snap, rules, as_of, with_trace).select(*CANDIDATE).unionByName(manual.select(*CANDIDATE))


def rule_transitions(snap: DataFrame, rules: list[dict], as_of: datetime.date) -> DataFrame:
    """The single next date after as_of on which each rule can change its answer, per employee."""
    day = F.lit(as_of).cast("date")

    def when(r: dict, c: CompiledRule) -> Column:
        window = [F.lit(r["valid_from"]).cast("date")] + ([F.lit(r["valid_to"]).cast("date")] if r["valid_to"] else [])
        return F.struct(F.lit(r["category_id"]).alias("category_id"), F.lit("RULE").alias("source"),
                        F.lit(r["version_id"]).alias("source_id"), next_date([*c.transition_dates, *window], day).alias("date"))

    entries = [when(r, c) for r, c in compiled(rules, as_of)]
    return snap.select("employee_id", F.explode(F.filter(F.array(*entries), lambda x: x["date"].isNotNull())).alias("t")).select(
        "employee_id", "t.*")


def override_transitions(overrides: DataFrame, as_of: datetime.date) -> DataFrame:
    """Start and end of each override that lie after as_of; both may come."""
    dates = F.filter(F.array("valid_from", "valid_to"), lambda d: d > F.lit(as_of).cast("date"))
    return overrides.select("employee_id", "category_id", F.lit("OVERRIDE").alias("source"),
                            F.col("id").cast("string").alias("source_id"), F.explode(F.array_distinct(dates)).alias("date"))


def next_transitions(parts: list[DataFrame]) -> DataFrame:
    """The next date of each scope over all sources."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("employee_id", "category_id").agg(F.min("date").alias("next_date"))


def fingerprint(snap: DataFrame, rules: list[dict], overrides: DataFrame, category: str, cardinality: str,
                as_of: datetime.date) -> DataFrame:
    """sha256 of everything a scope's evaluation reads: equal if and only if the inputs are."""
    facts = [r for r in compiled(rules, as_of) if r[0]["category_id"] == category]
    ruleset = F.array(*[F.struct(*[F.lit(str(x)) for x in (
        r["version_id"], c.content_hash, r["priority"], r["enabled"], r["valid_from"], r["valid_to"], r["policy_enabled"])]) for r, c in facts])
    manual = overrides.where(F.col("category_id") == category).groupBy("employee_id").agg(F.array_sort(F.collect_list(
        F.struct("id", "policy_id", "action", "priority", "valid_from", "valid_to"))).alias("manual"))
    stable = [c for c in snap.columns if c not in ("attributes", "group_ids")]
    return snap.join(manual, "employee_id", "left").select("employee_id", F.lit(category).alias("category_id"), F.sha2(F.to_json(F.struct(
        F.struct(*stable).alias("snapshot"), F.to_json("attributes").alias("attributes"), F.array_sort("group_ids").alias("groups"),
        F.lit(category).alias("category"), F.lit(cardinality).alias("cardinality"), ruleset.alias("rules"), F.col("manual"))), 256).alias("fingerprint"))
