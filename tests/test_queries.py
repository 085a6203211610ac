"""Every core query against its SQL on the smallest tables, as the driver compares them."""

import math

import duckdb
import pytest

from lexmill import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shape(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "~" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return list(df.columns), sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, db, name):
    got, want = shape(queries.QUERIES[name](spark, SF).toPandas()), shape(db.execute(queries.ORACLES[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows_only(spark, name):
    """Queries without SQL: rows come, the same ones twice."""
    df = queries.QUERIES[name](spark, SF)
    first = shape(df.toPandas())
    assert first[1] and first == shape(queries.QUERIES[name](spark, SF).toPandas())
