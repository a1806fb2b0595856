"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import answers, learned, studies  # noqa: F401
from graphloom.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(df):
    cols = sorted(df.columns)
    value = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return cols, sorted(repr([value(v) for v in row]) for row in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        assert canonical(got) == canonical(duck.sql(ORACLE[name]).df())
    else:
        assert len(got)
