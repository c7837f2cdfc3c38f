"""Every registered query of the library against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from orebody import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_all_but_the_folds_have_sql():
    assert set(plans.QUERIES) - set(plans.SQL) == {"c4_c6_chunks", "c12_pack_context"}


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, FOLDER)
    cur = duck.execute(plans.SQL[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(columns) == sorted(got.columns)
    rows = got.select(*[f"`{c}`" for c in columns]).collect()
    assert sorted([plain(x) for x in r] for r in rows) == sorted([plain(x) for x in r] for r in want)
