"""The queries that SQL can express, against their twins."""

from __future__ import annotations

import pytest

from flowgate.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    result = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted(tuple(repr(r[c]) for c in names) for r in df.collect())
    assert ours == sorted(tuple(map(repr, r)) for r in result.fetchall()) and ours
