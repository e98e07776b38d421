import glob
import os

import duckdb
import pytest

from entiloom.plans import star, star_documents  # noqa: F401
from tests.compare import rows

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(star.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = star.QUERIES[name](spark, SMALL)
    told = duck.sql(star.SQL[name])
    names = list(told.columns)
    assert sorted(got.columns) == sorted(names)
    assert rows([r.asDict() for r in got.collect()]) == rows([dict(zip(names, r, strict=True)) for r in told.fetchall()])
