"""Every registered query of the library against its SQL, over whole tables."""

import pathlib

import duckdb
import pytest
from msgspark import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in Q.ORACLE_SQL:
        found = duck.execute(Q.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(tuple(x[names.index(c)] for c in columns)) for x in found.fetchall())
    else:
        assert rows
