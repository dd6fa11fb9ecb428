"""Every query with an oracle gives the oracle's rows, at the smallest scale; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from gleanwright import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v + 0.0, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    cols, rows = sorted(df.columns), df.collect()
    if name not in plans.ORACLES:
        assert rows
        return
    r = db.execute(plans.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(str(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
    assert sorted(str(tuple(plain(x[c]) for c in cols)) for x in rows) == want
