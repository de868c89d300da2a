"""NTILE from cut values: equal to the window function on ties, NULLs and wide values."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.operators import cuts

BIG = (1 << 63) - 1


def _both(df, n, descending):
    order = [F.col("v").desc() if descending else F.col("v").asc(), F.col("id").asc()]
    want = {r.id: r.t for r in df.select("id", F.ntile(n).over(Window.orderBy(*order)).alias("t")).collect()}
    got = {r.id: r.t for r in cuts.ntiles(df, n, {"t": ("v", descending)}, "id").collect()}
    return got, want


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("values", [
    [], [None], [3, 1], [5] * 40, [None] * 12 + [1, 2, 3], list(range(97)), [7 if i % 3 else i * 10 ** 15 for i in range(120)],
    [-BIG - 1, BIG, 0, -1, None, BIG, -BIG - 1], [i * i * (-1) ** i for i in range(300)]])
def test_tiles_equal_the_window(spark, values, descending):
    df = spark.createDataFrame([(i * 37 - 500, v) for i, v in enumerate(values)], "id long, v long").repartition(3)
    got, want = _both(df, 5, descending)
    assert got == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.one_of(st.none(), st.integers(-3, 3), st.integers(-BIG - 1, BIG)), max_size=40), tiles=st.integers(1, 7), descending=st.booleans())
def test_tiles_property(spark, vals, tiles, descending):
    got, want = _both(spark.createDataFrame(list(enumerate(vals)), "id long, v long"), tiles, descending)
    assert got == want


def test_narrow_bins_need_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(cuts, "BINS", 4)
    df = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(10 ** 9)).alias("v"))
    got, want = _both(df, 5, True)
    assert got == want


@pytest.mark.parametrize("kind,values", [
    ("decimal(38,2)", [Decimal("1.10"), Decimal("-2.25"), None, Decimal("99999999999.99"), Decimal("1.10")]),
    ("date", [dt.date(2001, 1, 1), None, dt.date(1969, 5, 5), dt.date(2001, 1, 1), dt.date(2040, 1, 1)]),
    ("timestamp", [dt.datetime(2001, 1, 1), None, dt.datetime(2001, 1, 1, 0, 0, 1), dt.datetime(1950, 1, 1)]),
    ("int", [1, 5, 5, 5, None])])
def test_types(spark, kind, values):
    got, want = _both(spark.createDataFrame(list(enumerate(values)), f"id long, v {kind}"), 3, False)
    assert got == want


def test_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        cuts.ntiles(spark.createDataFrame([(1, 0.5)], "id long, v double"), 3, {"t": ("v", False)}, "id")


def test_a_null_tie_is_one_row(spark):
    df = spark.createDataFrame([(None, 4), (1, 4), (2, 4), (3, 9)], "id long, v long")
    got, want = _both(df, 2, False)
    assert got == want


def test_scores_share_the_jobs_and_nothing_is_sorted(spark):
    df = spark.range(3000).select("id", F.pmod("id", F.lit(7)).alias("a"), F.pmod(F.xxhash64("id"), F.lit(10 ** 6)).alias("b")).checkpoint()
    sc = spark.sparkContext
    sc.setJobGroup("cuts", "cuts")
    out = cuts.ntiles(df, 5, {"x": ("a", True), "y": ("b", False)}, "id")
    jobs = len(sc.statusTracker().getJobIdsForGroup("cuts"))
    sc.setJobGroup("none", "none")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert jobs <= 16  # two or three rounds for both scores, with Spark's own extra jobs of a round


def test_starts():
    assert cuts.starts(0, 5) == [] and cuts.starts(1, 5) == [] and cuts.starts(3, 5) == [2, 3]
    assert cuts.starts(12, 5) == [4, 7, 9, 11] and cuts.starts(10, 5) == [3, 5, 7, 9]
