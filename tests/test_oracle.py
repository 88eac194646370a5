"""Every registered query with an oracle equals the DuckDB SQL (sf0.001),
and the queries without one run and return rows."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as E
from orderpulse.plans.catalog import QUERIES
from orderpulse.plans.oracle import ORACLE

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
_spec = importlib.util.spec_from_file_location("oracle_check", os.path.join(ROOT, "scripts", "oracle_check.py"))
oc = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(oc)

SLOW = {"train_forest", "run_leaderboard"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in oc.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(ocols)
    order = sorted(cols)
    s = sorted(tuple(oc.norm(r[cols.index(c)]) for c in order) for r in srows)
    o = sorted(tuple(oc.norm(r[ocols.index(c)]) for c in order) for r in orows)
    assert len(s) == len(o)
    bad = [(a, b) for a, b in zip(s, o) if not all(oc.same(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:2]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_only(spark, name):
    assert E.queries()[name](spark, SF).count() > 0


def test_every_query_has_oracle_or_is_ml():
    missing = set(QUERIES) - set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert missing <= {"train_forest", "train_boosting", "score_batch", "run_leaderboard",
                       "score_text", "monthly_performance_model"}


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"feature", "month", "psi", "severity"}
