"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

from docforge.plans import registry

D = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no generated tables")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return v


def rows(pairs):
    return sorted((tuple(plain(v) for _, v in sorted(r.items())) for r in pairs), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"create view {f.split('.')[0]} as from '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(session, duck, name):
    got = registry.queries()[name](session, D)
    assert len(set(got.columns)) == len(got.columns)
    mine = rows(r.asDict() for r in got.collect())
    sql = registry.oracles().get(name)
    if not sql:
        return
    rel = duck.sql(sql)
    want = rows(dict(zip(rel.columns, r)) for r in rel.fetchall())
    assert sorted(got.columns) == sorted(rel.columns)
    assert len(mine) == len(want)
    for m, w in zip(mine, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-4) for x, y in zip(m, w)), (m, w)
