"""Every registered query with SQL gives the rows that DuckDB gives."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from barkeep.plans.catalog import QUERIES
from barkeep.plans.catalog_sql import ORACLES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    wanted = duck.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    rows = Counter(tuple(r[c] for c in columns) for r in found.collect())
    assert rows == Counter(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_no_python_in_plans(spark, name):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan
