"""Every query of the core that SQL expresses, against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from quillgraph.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.isoformat() if isinstance(x, datetime.date) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_against_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = tables.execute(registry.ORACLE[name])
    columns = sorted(df.columns)
    place = {c[0]: i for i, c in enumerate(want.description)}
    assert sorted(place) == columns
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(str([plain(r[place[c]]) for c in columns]) for r in want.fetchall())
