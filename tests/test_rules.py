"""The rule language, resolution and state, against small plain cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from datewise.functions import rules as R
from datewise.functions import text as T
from datewise.operators import resolve, verify
from datewise.operators.reconcile import Generations
from datewise.sources import ingest
from datewise.streaming import stream

DAY = datetime.date(2025, 12, 30)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"E-{i}", None, "CA", None if i == 2 else "Eng", "full_time", False, datetime.date(2024, 1, 1), a, g) for i, a, g in [
        (1, '{"level":4,"tags":["x"]}', ["g"]), (2, '{"level":4.0}', []), (3, '{"level":"4"}', []), (4, '{"level":null}', []),
        (5, "{}", []), (6, '{"level":[4]}', []), (7, '{"level":true}', [])]]
    df = spark.createDataFrame(rows, "id int, external_id string, email string, location string, department string, employment_type string, "
                                     "is_manager boolean, hire_date date, a string, group_ids array<string>")
    return df.withColumn("attributes", F.parse_json("a"))


def hits(people, condition):
    return {r["id"] for r in people.where(R.compile_rule(condition, F.lit(DAY)).predicate).select("id").collect()}


@pytest.mark.parametrize("condition, want", [
    (R.compare("attribute.level", "EQ", 4), {1, 2}),
    (R.compare("attribute.level", "NE", 4), {3, 4, 6, 7}),
    (R.compare("attribute.level", "EQ", "4"), {3}),
    (R.compare("attribute.level", "EQ", None), {4}),
    (R.compare("attribute.level", "NOT_IN", [4, None]), {3, 6, 7}),
    (R.none_of(R.compare("attribute.level", "EQ", 4)), {3, 4, 5, 6, 7}),
    (R.compare("attribute.level", "EQ", True), {7}),
    (R.compare("attribute.level", "GT", True), set()),
    (R.compare("department", "NE", "X"), {1, 2, 3, 4, 5, 6, 7}),
    (R.compare("department", "EQ", None), {2}),
    (R.compare("tenure_days", "GTE", 730), set()),
    (R.compare("tenure_days", "LT", 730), {1, 2, 3, 4, 5, 6, 7}),
    (R.group("g"), {1}),
])
def test_leaves(people, condition, want):
    assert hits(people, condition) == want


@pytest.mark.parametrize("bad", [
    {}, {"type": "and", "conditions": []}, R.compare("location", "IN", "CA"), R.compare("location", "EQ", ["CA"]), R.compare("tenure_days", "EQ", -1),
    R.compare("as_of_date", "EQ", "soon"), R.compare("salary", "EQ", 1), R.compare("location", "IN", ["x"] * 1001), {"type": "not", "condition": R.group("g"), "x": 1}])
def test_validation(bad):
    with pytest.raises(R.RuleError):
        R.validate(bad)


def test_dependencies_and_selectors():
    same, other = R.compare("location", "EQ", "CA"), R.compare("department", "IN", ["A", "B"])
    rule = R.compile_rule(R.all_of(R.any_of(R.all_of(same, other), R.all_of(same, R.group("g"))), R.compare("tenure_days", "GT", 5)), F.lit(DAY))
    assert [(d.type, d.key, d.mandatory) for d in rule.dependencies] == [
        ("FIELD", "department", False), ("FIELD", "hire_date", False), ("FIELD", "location", True), ("GROUP", "g", False), ("TIME", "tenure_days", False)]
    assert rule.specificity == 5
    assert R.compile_rule(json.dumps(rule.condition), F.lit(DAY)).content_hash == rule.content_hash
    compiler = R.RuleCompiler(F.lit(DAY))
    compiler.get("v", same)
    with pytest.raises(R.RuleError):
        compiler.get("v", other, R.compile_rule(other, F.lit(DAY)).content_hash)


def test_resolution(spark):
    rows = [(1, "c", "rule:a", "p", "RULE", "ASSIGN", 999, 1), (1, "c", "manual:b", "p", "MANUAL", "EXCLUDE", -999, 9), (1, "c", "rule:c", "q", "RULE", "ASSIGN", 1, 2),
            (1, "c", "rule:d", "r", "RULE", "ASSIGN", 1, 1), (2, "c", "rule:b", "q", "RULE", "ASSIGN", 1, 1), (2, "c", "rule:a", "r", "RULE", "ASSIGN", 1, 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "employee_id int, category_id string, candidate_id string, policy_id string, source string, action string, priority int, specificity long")
        one = {r["candidate_id"] for r in resolve.winners(resolve.judged(df, {"c": "SINGLE"})).collect()}
        many = {r["candidate_id"] for r in resolve.winners(resolve.judged(df, {"c": "MULTIPLE"})).collect()}
        assert one == {"rule:c", "rule:a"} and len(many) == 4
        lost = {(r["employee_id"], r["candidate_id"]): r["reason_lost"] for r in resolve.rejected(resolve.judged(df, {"c": "SINGLE"})).collect()}
        assert lost == {(1, "manual:b"): resolve.EXCLUDED, (1, "rule:a"): resolve.VETOED, (1, "rule:d"): resolve.SPECIFICITY_WON, (2, "rule:b"): resolve.TIE_BREAK}


def test_text(spark):
    df = spark.createDataFrame([("POLICE DEPT OF NEW YORK",), ("already Mixed",), ("** NYC-HRA AT WORK",), (None,)], "t string")
    assert [r[0] for r in df.select(T.format_imported(F.col("t"))).collect()] == ["Police Dept of New York", "already Mixed", "NYC-HRA at Work", None]
    assert spark.range(1).select(T.humanize(F.lit("SENIOR it-staff"))).first()[0] == "Senior It-Staff"
    key = spark.range(1).select(T.derived_key("dep", F.array(F.lit("Fire & Rescue")))).first()[0]
    assert key.startswith("dep-fire-rescue-") and len(key) == len("dep-fire-rescue-") + 8


def test_generations(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/state")
    assert g.read() is None
    g.publish(spark.range(3))
    g.publish(spark.range(5))
    assert g.newest() == 2 and g.read().count() == 5


def test_stream_runs_each_scope_once(spark, tmp_path):
    rows = [{"event_id": i, "company_id": "c", "kind": "K", "dedupe_key": f"k{i % 3}", "created_at": "2024-01-01T00:00:00Z", "employee_id": i % 3,
             "category_id": "main"} for i in range(9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    query = stream.reconcile_stream(stream.read_events(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/check",
                                    lambda scopes, n: seen.extend(tuple(r) for r in scopes.collect()))
    query.awaitTermination()
    assert sorted(seen) == [(0, "main"), (1, "main"), (2, "main")]


def test_fetch_retries():
    import io
    import urllib.error

    calls, waits = [], []

    def open_url(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return io.BytesIO(b'[{"a": 1}]')

    assert ingest.fetch_rows("http://x", wait=waits.append, open_url=open_url) == [{"a": 1}]
    assert waits == [0.25, 0.5]


def test_plans_are_reproducible():
    plan = verify.mutation_plan(7, 500, 100)
    assert plan == verify.mutation_plan(7, 500, 100) and {m["kind"] for m in plan} == set(verify.MUTATIONS)
    groups = verify.batches(plan, 10)
    assert sum(groups, []) == plan and all(len(b) == 1 or not any(m["kind"] in verify.GLOBAL for m in b) for b in groups)
