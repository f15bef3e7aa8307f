import os

import duckdb
import pytest

from tessera import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got = catalog.QUERIES[name](spark, DATA)
    want = db.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(str([r[c] for c in columns]) for r in part) for part in ((r.asDict() for r in got.collect()), (dict(zip(want.columns, r, strict=True)) for r in want.fetchall()))]
    assert rows[0] == rows[1]
