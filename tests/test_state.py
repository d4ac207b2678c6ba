"""The engine against plain Python, published state, the stream, sinks and the compiler cache."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from datewise.functions import rules as R
from datewise.operators import batch, evaluate, resolve
from datewise.plans.core import DAY, Data
from datewise.sources import fixtures as fx
from datewise.sources import sinks
from datewise.sources.generations import State
from datewise.streaming import stream

from . import plain_oracle


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark, "/root/testdata/sf0.01")


def test_assignments_like_plain_python(data):
    rows = [r.asDict() | {"attributes": json.loads(r["attributes_text"])} for r in data.snap().withColumn(
        "attributes_text", F.to_json("attributes")).drop("attributes").collect()]
    overrides = {}
    for o in data.overrides.collect():
        overrides.setdefault(o["employee_id"], []).append(o.asDict())
    want = {(r["employee_id"], *p) for r in rows for p in plain_oracle.assigned(
        r, fx.RULES, overrides.get(r["employee_id"], []), fx.CATEGORIES, DAY)}
    got = {tuple(r) for r in data.assigned().collect()}
    assert len(rows) > 1000 and got == want
    assert len({p for _, _, p in got}) > 6


def test_calendar_dates_and_cache():
    with pytest.raises(R.RuleError):
        R.validate(R.compare("as_of_date", "EQ", "2024-02-31"))
    R.validate(R.compare("as_of_date", "EQ", "2024-02-29"))
    assert R.content_hash(R.compare("attribute.level", "EQ", 4.0)) == R.content_hash(R.compare("attribute.level", "EQ", 4))
    rule = fx.RULES[0] | {"rule_id": "t", "version_id": "t-v1"}
    day = datetime.date(2001, 1, 1)
    evaluate.compiled([rule], day)
    with pytest.raises(R.RuleError):
        evaluate.compiled([rule | {"condition": R.compare("department", "NE", "other")}], day)


def test_one_category_at_a_time(data):
    found = evaluate.candidates(data.snap().limit(50), fx.RULES, data.overrides, DAY)
    with pytest.raises(resolve.ResolutionError):
        resolve.resolve_category(found, "main", "SINGLE")


def test_batch_refuses_repeated_scopes(spark, data, tmp_path):
    state = State(spark, f"file://{tmp_path}/state")
    scopes = data.scopes().where("employee_id < 5")
    with pytest.raises(batch.BatchError):
        batch.reconcile_batch(state, scopes.union(scopes), data.snap(), fx.RULES, data.overrides, fx.CATEGORIES, DAY, "x")
    assert state.newest() == 0


def test_stream_reconciles_and_replays(spark, data, tmp_path):
    """Two files of events; the second names a scope again; a batch that is replayed publishes nothing."""
    state = State(spark, f"file://{tmp_path}/state")
    counts = []

    def each(scopes, batch_id):
        counts.append(batch.reconcile_batch(state, scopes, data.snap(), fx.RULES, data.overrides, fx.CATEGORIES, DAY, f"b{batch_id}"))

    (tmp_path / "in").mkdir()
    event = {"event_id": 1, "company_id": "c1", "kind": "EMPLOYEE", "dedupe_key": "a", "created_at": "1999-06-30T00:00:00", "employee_id": 7, "category_id": "main"}
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(event | {"dedupe_key": k, "employee_id": e}) for k, e in (("a", 7), ("a", 7), ("b", 8))))
    stream.reconcile_stream(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "check"), each).awaitTermination(120)
    assert counts[0]["scopes"] == 2 and state.newest() == 1
    again = data.scopes().where("employee_id IN (7, 8) AND category_id = 'main'")
    assert batch.reconcile_batch(state, again, data.snap(), fx.RULES, data.overrides, fx.CATEGORIES, DAY, "b0") == {}
    once_more = batch.reconcile_batch(state, again, data.snap(), fx.RULES, data.overrides, fx.CATEGORIES, DAY, "other")
    assert once_more["decisions_inserted"] == 0 and "added" not in once_more and "removed" not in once_more


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("1", "nyc-1", "x"), ("2", "nyc-2", "y")], "source_row_id string, external_id string, checksum string")
    assert sinks.write_import(rows, "c0", path) == 2
    sinks.copy_tenant(path, spark, "c0", "c1")
    assert sinks.write_import(rows.limit(1), "c0", path) == 1
    read = lambda name, c: spark.read.parquet(f"{path}/{name}").where(f"company_id = '{c}'").count()
    assert (read("employees", "c0"), read("employees", "c1")) == (1, 2)
    for _ in range(2):
        sinks.reset_and_import({"employees": rows}, "c1", path, ("employees", "import_records"))
    sinks.reset_and_import({"employees": rows}, "c0", path, ("employees", "import_records"))
    assert read("employees", "c0") == read("employees", "c1") == 2
    sinks.write_replay(spark, 482901, [{"kind": "x"}], f"{path}/replay")
    assert sinks.read_replay(spark, f"{path}/replay") == (482901, [{"kind": "x"}])
    got = sinks.benchmark_artifact(spark, spark.range(1, 101).withColumn("ms", F.col("id").cast("double")), "ms", f"{path}/bench")
    assert got == {"count": 100, "p50": 50.0, "p95": 95.0, "p99": 99.0}
    schemas = sinks.Schemas(spark, path)
    assert schemas.apply({"a": "x int", "b": "y string"}) == ["a", "b"] and schemas.apply({"a": "x int"}) == []
    with pytest.raises(sinks.SinkError):
        schemas.apply({"a": "x bigint"})
