"""Every query of the engine against its SQL, over the whole small tables; those without SQL must run."""

from __future__ import annotations

import pytest
from conftest import SMALL

from driftwell import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(same, name):
    same(Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
