"""Every query that SQL can express, against DuckDB over the smallest tables."""

import importlib
import os
import sys
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
MODULES = ["weftline.problems", *(f"weftline.catalogue.{m}" for m in ("relational", "temporal", "graph", "cases", "views"))]
CASES = [(m, q) for m in MODULES for q in importlib.import_module(m).oracle_sql()]


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize(("module", "name"), CASES, ids=[q for _, q in CASES])
def test_same_rows(spark, con, module, name):
    m = importlib.import_module(module)
    df = m.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(m.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


def test_entry_is_complete(spark):
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    assert {"p1_found", "p3_found", "p4_found"} <= set(qs)
    assert e.entry(spark).count() > 0
