"""Every query with SQL against DuckDB at the smallest scale."""

import duckdb
import pytest

from rillflow.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cell = lambda v: None if v is None or v != v else float(v) if hasattr(v, "dtype") and v.dtype.kind == "f" or isinstance(v, float) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLE_SQL[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6, nan_ok=True) if all(isinstance(x, float) for x in a) else all(x == y or (isinstance(x, float) and y == pytest.approx(x, abs=2e-6)) for x, y in zip(a, b, strict=True))
