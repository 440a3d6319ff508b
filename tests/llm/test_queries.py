"""Every query of the problems on small and on empty tables, and those with SQL against it."""

import os

import duckdb
import pytest

from webobs.llm.oracles import ORACLES
from webobs.llm.queries import QUERIES

DATA = os.environ.get("WEBOBS_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
FOUND = {"p1_found": ["as_id", "net_id"], "p2_found": ["page_id", "line_no"], "p3_found": ["rec_table", "rec_id"], "p5_found": ["keep_id", "row_id"], "p6_found": ["page_a", "page_b"], "p7_found": ["doc_id", "item_id"]}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(str(d / f))
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in FOUND:
        assert df.columns == FOUND[name] and len(set(got)) == len(got) > 0
    if name in ORACLES:
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
        assert sorted(got, key=repr) == sorted(c.execute(ORACLES[name]).fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []
