"""Reconcile a batch: evaluate its scopes, keep decisions, diff, write assignments with history, reschedule."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.generations import State
from . import evaluate, reconcile, resolve

SCOPE = ["employee_id", "category_id"]
DECISIONS = ("employee_id long, category_id string, as_of date, fingerprint string, decision_id string, decided_at int, "
             "winners array<string>, rejected array<string>")
ASSIGNMENTS = "employee_id long, category_id string, policy_id string, slot_key string, decision_id string, effective_from date"
HISTORY = "employee_id long, category_id string, policy_id string, valid_from date, valid_to date"
TRANSITIONS = "employee_id long, category_id string, source string, source_id string, date date, processed boolean"
#: The tables of a generation.
TABLES = {"decisions": DECISIONS, "assignments": ASSIGNMENTS, "history": HISTORY, "transitions": TRANSITIONS}


class BatchError(ValueError):
    pass


def reconcile_batch(state: State, scopes: DataFrame, snap: DataFrame, rules: list[dict], overrides: DataFrame,
                    cardinality: dict[str, str], as_of: datetime.date, batch_id: str) -> dict[str, int]:
    """Bring the scopes up to date as of a day and publish one generation; the counts of what changed.

    A batch id that was published before, and a batch without scopes, change and
    count nothing, so a replay is harmless. Scopes may not repeat. A scope whose inputs have the
    fingerprint of an earlier decision of the same day keeps that decision;
    rows that stay keep their decision and start. There is a single writer.
    """
    if state.published(batch_id) is not None:
        return {}
    scopes = scopes.select(*SCOPE)
    if scopes.isEmpty():
        return {}
    if scopes.groupBy(*SCOPE).count().where("count > 1").limit(1).count():
        raise BatchError("a reconciliation batch contains duplicate scopes")
    day, now = F.lit(as_of).cast("date"), state.newest() + 1
    rules = [r for r in rules if r["category_id"] in cardinality]
    # Only employees of the batch are evaluated; their evaluation is written once and read by all that follows.
    people = scopes.select("employee_id").distinct()
    mine, manual = snap.join(people, "employee_id", "left_semi"), overrides.join(scopes, SCOPE, "left_semi")
    found = evaluate.candidates(mine, rules, manual, as_of).join(scopes, SCOPE, "left_semi")
    judged = state.stage("judged", resolve.judged(found, cardinality))
    prints = None
    for category, kind in cardinality.items():
        part = evaluate.fingerprint(mine, rules, manual, category, kind, as_of)
        prints = part if prints is None else prints.unionByName(part)
    fresh = scopes.join(prints, SCOPE, "left").select(*SCOPE, day.alias("as_of"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    old = {name: state.read(name, schema) for name, schema in TABLES.items()}
    decided = state.stage("decided", reconcile.reuse_decisions(old["decisions"], fresh))
    ids = [F.transform(c, lambda x: x["policy_id"]).alias(c) for c in ("winners", "rejected")]
    evidence = resolve.decisions(judged, scopes).select(*SCOPE, *ids)
    new = state.stage("new", decided.where("NOT reused").join(evidence, SCOPE).withColumn("decided_at", F.lit(now)))
    diff = state.stage("diff", reconcile.difference(old["assignments"], resolve.winners(judged), scopes))
    loaded = overrides.where(~F.col("revoked") & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))
    timers = evaluate.rule_transitions(mine, rules, as_of).select(*SCOPE, "source", "source_id", "date").unionByName(
        evaluate.override_transitions(loaded, as_of).select(*SCOPE, "source", "source_id", "date")).join(scopes, SCOPE, "left_semi")
    states = {r["state"].lower(): r["count"] for r in diff.groupBy("state").count().collect()}
    counts = {"scopes": scopes.count(), "decisions_inserted": new.count()} | states
    state.publish({
        "decisions": old["decisions"].unionByName(new.select(*old["decisions"].columns)),
        "assignments": reconcile.apply_difference(old["assignments"], diff, decided, cardinality, day),
        "history": reconcile.close_history(old["history"], diff, day),
        "transitions": reconcile.replace_transitions(old["transitions"], timers, scopes, day),
    }, batch_id)
    return counts
