"""Every registered query of the library runs; those with a twin give its rows."""

from __future__ import annotations

import pytest

from tessera.queries import ORACLES, QUERIES

from .oracle import connection, same


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 80


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_twin(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    twin = connection(sf_dir).sql(ORACLES[name]).df()
    assert len(rows), "an empty comparison shows nothing"
    same(rows, twin)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_some_average_precision_is_not_trivial(spark, sf_dir):
    values = [r.ap for r in QUERIES["map_area"](spark, sf_dir).collect()]
    assert any(0 < v < 1 for v in values)
