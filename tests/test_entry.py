import duckdb
import pytest

import __spark_entry__ as entry
from sitometra.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE_SQL[name])
    names = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == names
    at = [[x[0] for x in want.description].index(n) for n in names]
    key = lambda r: [(x is None, str(x)) for x in r]
    ours = sorted(([_plain(r[n]) for n in names] for r in got.collect()), key=key)
    theirs = sorted(([_plain(r[i]) for i in at] for r in want.fetchall()), key=key)
    assert ours == theirs
