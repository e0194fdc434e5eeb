"""Every registered query of the core against its SQL counterpart, on the smallest tables."""

import importlib
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as entry  # noqa: E402
from compare import canonical  # noqa: E402
from cuespark.plans import registry  # noqa: E402

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIRECTORY).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for p in Path(DIRECTORY).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db


def compare(spark, database, name, query, sql):
    got = query(spark, DIRECTORY).toArrow()
    if sql is not None:
        want = database.sql(sql).to_arrow_table()
        import pandas as pd

        assert sorted(got.column_names) == sorted(want.column_names)
        assert canonical(got.to_pandas(types_mapper=pd.ArrowDtype)) == canonical(pa.table(want).to_pandas(types_mapper=pd.ArrowDtype))
    return got


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, database, name):
    compare(spark, database, name, registry.queries()[name], registry.oracles().get(name))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_subpackage(monkeypatch):
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None)
    assert set(entry.queries()) == set(registry.queries())
    for path in (Path(__file__).parents[1] / "cuespark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "cuespark.llm" not in path.read_text(), path
