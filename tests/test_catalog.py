from __future__ import annotations

import pytest

from rankloom.plans import catalog, space
from tests.oracle import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    assert rows_of(catalog.queries()[name](spark, SF)) == rows_of_sql(catalog.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_inout_on_a_graph_beyond_arrays(spark, monkeypatch):
    """Its edges stay in blocks; tables would take several jobs for each of its hundred products."""
    monkeypatch.setattr(space, "ARRAY_EDGES", 0)
    monkeypatch.setattr(space, "TableSpace", None)
    name = "inout_converged_supply"
    assert rows_of(catalog.queries()[name](spark, SF)) == rows_of_sql(catalog.oracle_sql()[name], SF)
