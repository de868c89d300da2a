"""Every registered query against its DuckDB oracle (sf0.001), entry() smoke,
and plan-shape checks for the scale patterns."""

import duckdb
import pytest

import __spark_entry__ as E
from ledgerlake.plans import catalog
from tools.check_oracle import canon, close
from ledgerlake.sources.testdata import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = _plan(df)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no Python UDF
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan  # no cross joins
    sc, sr = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    oc, orr = canon([d[0] for d in res.description], res.fetchall())
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr or close(sr, orr)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rfm_segments", "rfm_churn", "top_10_customers", "top_5_products"])
def test_no_global_rank_window(spark, name):
    """NTILE / RANK over every customer or product would run in one task."""
    plan = _plan(QUERIES[name](spark, SF)).lower()
    assert "ntile(" not in plan and "rank(" not in plan


def test_scan_prunes_columns(spark):
    df = QUERIES["revenue_by_month"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan and "o_orderpriority" not in plan


@pytest.fixture(scope="module")
def gold_model(spark, tmp_path_factory):
    from ledgerlake.model import GoldModel
    root = str(tmp_path_factory.mktemp("gold"))
    GoldModel.from_testdata(spark, SF).write(root)
    return GoldModel.from_parquet(spark, root)


@pytest.mark.parametrize("name", sorted(n for n, e in __import__("ledgerlake.plans.catalog", fromlist=["REGISTRY"]).REGISTRY.items() if e.build is not None))
def test_gold_layer_matches_oracle(spark, con, gold_model, name):
    """The analytics on the written gold layer (fact partitioned by year)
    give the same rows as on the driver tables."""
    from ledgerlake.plans.catalog import REGISTRY
    e = REGISTRY[name]
    df = e.build(gold_model, e.params)
    sc, sr = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    oc, orr = canon([d[0] for d in res.description], res.fetchall())
    assert sc == oc and (sr == orr or close(sr, orr))
