"""Every registered query against its SQL, values and types."""

import uuid

import pytest
from oracle import SF_DIR, connect, differences

import __spark_entry__ as registry

QUERIES = registry.bill_queries()
SQL = registry.bill_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_entry(spark):
    assert registry.entry(spark).count() > 0


def test_written_files_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "scratch_dir", lambda _: f"{tmp_path}/{uuid.uuid4().hex}")
    for name in ("ingest_csv", "table_load", "table_growth"):
        assert QUERIES[name](spark, SF_DIR).count() > 0
    assert len(list(tmp_path.iterdir())) == 3
    assert all(p.name.endswith("-result") for p in tmp_path.iterdir())
