"""Every registered query: against its SQL where there is one, else that it gives rows."""

from __future__ import annotations

import pytest

from regmodel.plans import registry

from .compare import database, rows


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, db, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(db.sql(registry.ORACLES[name]).df())
    else:
        assert len(got)


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert "topic_answers" in registry.QUERIES
