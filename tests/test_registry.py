import math
from pathlib import Path

import duckdb
import pytest

from genomill.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_spark_and_sql_agree(spark, sql, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = sql.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == columns
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    want = sorted(relation.select(", ".join(columns)).fetchall(), key=key)
    assert got == want


def test_principal_components(spark):
    rows = registry.QUERIES["pca"](spark, DATA).collect()
    values = list(rows[0])[1:]
    assert rows[0].indv == "EIGENVALUE" and values == sorted(values, key=lambda v: -v * v)
    for k in range(len(values)):
        assert math.isclose(sum(r[k + 1] ** 2 for r in rows[1:]), 1, rel_tol=1e-6)
