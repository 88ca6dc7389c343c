"""Every registered query of the study side against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from fieldloom.plans.catalogue import QUERIES
from fieldloom.plans.oracle import ORACLE

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="needs the sample tables")


@pytest.fixture(scope="module")
def database():
    import duckdb

    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, str(TABLES))
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = database.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert found == wanted


def test_rows_of_a_support_are_counted_once_before_the_join(spark):
    plan = QUERIES["rule_w15"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[used" in plan
