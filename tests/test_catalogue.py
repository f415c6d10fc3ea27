"""Every query of the catalogue at sf0.001, against its SQL in DuckDB where there is one."""

import math

import duckdb
import pytest

from tests.conftest import SMALL, TABLES
from veldspar.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.ORACLE:
        rel = duck.execute(catalogue.ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        expected = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
        assert rows == expected
