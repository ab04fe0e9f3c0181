"""Registered queries next to their SQL at the smallest scale, and the shape of the registry.

Every query runs; VITALGRID_SOME=1 runs a spread of them.
"""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import canon, connect, same

SF = "/root/testdata/sf0.001"
ALL = not os.environ.get("VITALGRID_SOME")
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES if ALL else NAMES[::4])
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols, rows = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want_cols, want = canon([c[0] for c in cur.description], cur.fetchall())
    assert cols == want_cols and len(rows) == len(want)
    bad = [(c, a, b) for x, y in zip(rows, want) for c, a, b in zip(cols, x, y) if not same(a, b)]
    assert not bad, bad[:5]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "gad7" in df.columns
