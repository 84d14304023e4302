"""Every query with SQL agrees with DuckDB on the given tables; every query keeps all rows."""

import os

import duckdb
import pytest

from siteweave.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(r) for r in got.select(*columns).collect())
    want = sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
    assert rows == want


PER_DOCUMENT = sorted(set(QUERIES) - {"op5_vector_duplicates", "op10_decontamination", "op12_lexical_search"})


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_query_has_a_row_per_document(spark, duck, name):
    ids = sorted(r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == [r[0] for r in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
