import os

import pytest

from docforge.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no generated tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"create view {f.split('.')[0]} as from '{D}/{f}'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(dict(zip(rel.columns, r))[c] for c in order) for r in rel.fetchall())


def test_every_dealt_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
