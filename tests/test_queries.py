"""Every registered query outside the training-data subpackage, against its SQL twin in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from docloom.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    yield con
    con.close()


def plain(rows):
    return sorted(tuple(round(float(v), 6) if isinstance(v, float) else str(v) for v in row) for row in rows)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], plain([[row[i] for i in at] for row in rows])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    mine = ordered(found.columns, [tuple(r) for r in found.collect()])
    told = duck.execute(ORACLES[name])
    assert mine == ordered([c[0] for c in told.description], told.fetchall())
    assert mine[1], "no rows to compare"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
