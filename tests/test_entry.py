"""Registered queries against their SQL equivalents on the smallest tables, and the entry module itself."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from folioscope.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    assert got == want


def test_every_equivalent_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def test_works_without_the_optional_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *_):\n"
        "        if name.startswith('folioscope.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'p3_found' in e.queries() and 'p7_ids' not in e.queries() and 'bm25_topk' in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
