"""Every query with SQL against that SQL in another engine."""

import math
from pathlib import Path

import duckdb
import pytest

from seqcycle.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    number = float(v)
    return "nan" if math.isnan(number) else repr(round(number, 6) + 0.0)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(canon(r[c]) for c in columns) for r in df.collect())
    cursor = sql.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted("|".join(canon(r[i]) for i in order) for r in cursor.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
