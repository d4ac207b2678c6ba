"""Every registered query of the engine against its DuckDB twin, and the shape of those without one."""

import os

import duckdb
import pytest

from datewise.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NO_TWIN = {"input_fingerprint", "import_checksum", "role_families", "universe_fingerprint"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_all_but_a_few_have_a_twin():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == NO_TWIN


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, db, name):
    got = catalogue.queries()[name](spark, sf_dir)
    rows = got.collect()
    if name in NO_TWIN:
        assert rows
        return
    want = db.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    want_rows = sorted((tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in want.fetchall()), key=key)
    got_rows = sorted((tuple(r[c] for c in sorted(cols)) for r in rows), key=key)
    assert got_rows == want_rows
