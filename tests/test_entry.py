"""The registered queries: plans without cross joins or Python, results equal to DuckDB."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as E

from sample_tables import SF

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 3 and {r["type"] for r in rows} == {"range", "not_null", "categorical"}


def test_every_query_has_an_oracle():
    assert set(E.QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_query_equals_oracle(spark, db, name, capsys):
    df = E.queries()[name](spark, SF)
    capsys.readouterr()
    df.explain()
    plan = capsys.readouterr().out
    assert "FileScan" in plan
    for unwanted in ("Cartesian", "NestedLoop", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert unwanted not in plan
    cur = db.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
    got = sorted((tuple(r[n] for n in sorted(names)) for r in df.collect()), key=repr)
    expected = sorted(
        (tuple(plain(dict(zip(names, r))[n]) for n in sorted(names)) for r in cur.fetchall()), key=repr)
    assert got == expected
