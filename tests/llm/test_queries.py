import os

import pytest

import __spark_entry__ as entry
from folioscope.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


def test_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and set(oracle.ORACLE) <= set(queries.QUERIES)
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 6, 8, 9)} | {"p7_ids"} <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
@pytest.mark.parametrize("name, columns", [("p1_found", "bundle item_a item_b"), ("p2_found", "record_table record_id kind"), ("p4_found", "section_id"), ("p5_found", "kind name_a name_b"), ("p6_found", "paper_a paper_b"), ("p7_ids", "doc_id ids"), ("p8_found", "doc_id item_id"), ("p9_found", "doc_id")])
def test_columns_and_distinct_rows(spark, name, columns):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == columns.split()
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_against_brute_force(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    r = con.execute(oracle.ORACLE[name])
    assert [c[0] for c in r.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(r.fetchall())
