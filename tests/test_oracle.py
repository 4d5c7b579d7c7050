"""Every registered query against its SQL twin: same columns, same rows, same values."""

from __future__ import annotations

import functools
import math

import pytest

import catalog
from catalog import gates

runs_once = functools.lru_cache(maxsize=None)(gates.runs)


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


@pytest.fixture(autouse=True)
def shared_runs(monkeypatch):
    """The gate queries all read the same run table; compute it once."""
    monkeypatch.setattr(gates, "runs", runs_once)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    result = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
