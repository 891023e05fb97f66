"""Every registered core query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lemmata import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not Path(SF).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    c = db.execute(queries.ORACLES[name])
    names = [x[0] for x in c.description]
    want = sorted(tuple(plain(r[names.index(n)]) for n in got.columns) for r in c.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == want


def test_trees_round_trip(spark):
    rows = queries.QUERIES["tree_nodes"](spark, SF)
    bad = rows.groupBy("key").agg({"status": "max"}).where("`max(status)` like 'error%'")
    assert 0 < bad.count() < rows.select("key").distinct().count()
