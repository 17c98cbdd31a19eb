"""Every registered query of the engine against its SQL."""

import math
import os

import duckdb
import pytest

from platterlake import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else round(float(v), 5)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    frame = plans.queries()[name](spark, DATA)
    found = sql.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(repr(tuple(norm(r[columns.index(c)]) for c in sorted(columns))) for r in found.fetchall())
    assert sorted(repr(tuple(norm(r[c]) for c in sorted(columns))) for r in frame.collect()) == want
