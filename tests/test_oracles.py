"""Every query against its SQL over a whole small data folder."""

from __future__ import annotations

import os

import pytest
from conftest import DATA, KINDS, database, rows_of, sql_rows

from haulmark import plans

SF = DATA / os.environ.get("ORACLE_SF", "sf0.001")


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_rows_equal_those_of_sql(spark, db, name):
    frame = plans.QUERIES[name](spark, str(SF))
    want, kinds = sql_rows(db, plans.ORACLES[name])
    assert {n: KINDS.get(t, t) for n, t in frame.dtypes if not t.startswith("array")} == {n: t for n, t in kinds.items() if not t.endswith("[]") and not t.startswith("list")}
    got = rows_of(frame)
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, different[:3]
    assert got or name in EMPTY


#: Queries that find nothing in the smallest data, whose road graph is thin.
EMPTY = {"feasibility_certificate"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert plans.QUERIES[name](spark, str(SF)).count() > 0
