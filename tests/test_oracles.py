"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from takeledger.plans import registry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

duckdb = pytest.importorskip("duckdb")


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.6g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_oracle(spark, connection, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    result = connection.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert got == want
