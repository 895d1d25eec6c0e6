import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from keytide.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["key", "value", "version"] and df.count() > 0


def test_registry():
    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_without_the_optional_part(monkeypatch):
    whole = importlib.import_module

    def found(name):
        if name.startswith(("keytide.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return whole(name)

    monkeypatch.setattr(importlib, "import_module", found)
    assert set(driver.queries()) == set(queries.QUERIES) and set(driver.oracle_sql()) == set(queries.ORACLES)


def norm(rows):
    cell = lambda v: "-" if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{SF}/events.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert norm(got.select(*names).collect()) == norm(want.project(", ".join(f'"{n}"' for n in names)).fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize(("name", "pushed"), [("get_hit", "EqualTo(key,user:000001)"), ("scan_prefix", "StringStartsWith(key,user:00010)"), ("scan_from", "GreaterThanOrEqual(key,user:00010)"), ("scan_range", "LessThan(key,user:00013)"), ("scan_json", "StringStartsWith(key,user:00010)")])
def test_key_filters_reach_the_files(spark, name, pushed):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan


def test_a_missing_dependency_leaves_the_rest(monkeypatch):
    whole = importlib.import_module
    monkeypatch.setattr(importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")) if name.startswith(("keytide.llm", "corpus_pipeline")) else whole(name))
    assert set(driver.queries()) == set(queries.QUERIES) and set(driver.oracle_sql()) == set(queries.ORACLES)


def test_errors_of_the_rest_are_not_hidden(monkeypatch):
    def broken(name):
        raise ValueError("broken")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ValueError):
        driver.queries()
