"""Scale operators must equal the plain window functions they replace."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.operators.ntile import global_ntile, global_row_number
from ledgerlake.operators.running import running_by_order
from ledgerlake.operators.topk import top_k_with_ties


def _key(t):
    return tuple((x is None, 0 if x is None else x) for x in t)


def _frame(spark, n, distinct, seed, nulls=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = rnd.randrange(distinct)
        if nulls and rnd.random() < 0.1:
            v = None
        rows.append((i, v))
    return spark.createDataFrame(rows, "id long, v long")


@pytest.mark.parametrize("n,tiles,distinct", [(3, 5, 3), (7, 5, 7), (100, 5, 4), (257, 5, 1000), (64, 3, 1)])
def test_global_ntile_equals_ntile(spark, n, tiles, distinct):
    df = _frame(spark, n, distinct, seed=n)
    order = [F.col("v").desc(), F.col("id").asc()]
    want = {r.id: r.t for r in df.select("id", F.ntile(tiles).over(Window.orderBy(*order)).alias("t")).collect()}
    got = {r.id: r.t for r in global_ntile(df, tiles, order, "t", partitions=4).collect()}
    assert got == want


def test_global_row_number_with_heavy_tie(spark):
    # a third of the rows share one value: the range partitioner must still cut it
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long")
    order = [F.col("v").asc(), F.col("id").asc()]
    want = {r.id: r.rn for r in df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn")).collect()}
    got = {r.id: r.rn for r in global_row_number(df, order, "rn", partitions=6).collect()}
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 5, 50])
def test_top_k_with_ties_equals_rank_filter(spark, k):
    df = _frame(spark, 40, 6, seed=k, nulls=True)
    ranked = df.select("id", "v", F.rank().over(Window.orderBy(F.col("v").desc())).alias("r"))
    want = sorted((r.id, r.r) for r in ranked.where(F.col("r") <= k).collect())
    got = sorted((r.id, r.rk) for r in top_k_with_ties(df, "v", k, "rk").collect())
    assert got == want


def test_top_k_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5)], "id long, v long")
    got = sorted((r.id, r.rk) for r in top_k_with_ties(df, "v", 10, "rk").collect())
    assert got == [(1, 1), (2, 3), (3, 1)]


def test_running_by_order_matches_range_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.choice([2001, 2002, 2003, None]), rnd.randrange(100), rnd.choice([None, 1, 2]))
            for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, d int, x long, y long")
    w = Window.orderBy("d")  # default frame: RANGE UNBOUNDED PRECEDING .. CURRENT ROW (peers included)
    want = sorted((tuple(r) for r in df.select("g", "d", "x", "y", F.sum("x").over(w).alias("s"),
                                                F.avg("y").over(w).alias("a")).collect()), key=_key)
    got = sorted((tuple(r) for r in running_by_order(df, ["d"], sums={"s": "x"}, avgs={"a": "y"}).collect()),
                 key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert (a[5] is None and b[5] is None) or abs(a[5] - b[5]) < 1e-9


def test_running_by_order_partitioned(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 10), ("b", 1, 5)], "g string, d int, x long")
    got = sorted(tuple(r) for r in running_by_order(df, ["d"], sums={"s": "x"}, partition_cols=["g"]).collect())
    assert got == [("a", 1, 1, 1), ("a", 2, 2, 3), ("b", 1, 5, 15), ("b", 1, 10, 15)]


def test_hot_value_is_split_by_range_partitioning(spark):
    """A third of the rows share one ordering value; ranging on (value, tie)
    still spreads them, so no partition holds the hot group alone."""
    n, parts = 3000, 6
    rows = [(i, 42 if i % 3 == 0 else i) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v long")
    sizes = [r["count"] for r in df.repartitionByRange(parts, "v", "id")
             .groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == parts and max(sizes) < 2 * n / parts
