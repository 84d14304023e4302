"""Every registered query against its DuckDB counterpart."""

import pytest

import __spark_entry__ as driver
from checks import registry
from checks.compare import connect, difference
from conftest import plan_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    assert difference(df, duck, registry.ORACLES[name]) is None
    plan = plan_of(df)
    for node in ("Python", "ArrowEval", "CartesianProduct", "NestedLoopJoin"):
        assert node not in plan


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows(spark):
    rows = driver.entry(spark).collect()
    assert {r["source"] for r in rows} == {"half1", "half2"}


def test_only_the_left_out_modules_may_be_missing():
    import __spark_entry__ as entry

    for name in ("corpus_pipeline", "siteweave.llm", "siteweave.llm.registry"):
        entry.left_out(ImportError(name=name))
    for name in ("xxhash", "siteweave.operators", None):
        with pytest.raises(ImportError):
            entry.left_out(ImportError(name=name))
