"""Boundary values of the segment / risk rules (FIXTURES.md §4) and an SCD
property test over random batch sequences."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.model import GoldModel
from ledgerlake.operators import scd
from ledgerlake.params import DEFAULT
from ledgerlake.plans import reports, rfm


def test_risk_and_health_boundaries(spark):
    ratios = [0.99, 1.0, 1.05, 1.1, 2.0, 2.5, 2.51, 3.0, 3.01, None]
    df = spark.createDataFrame([(r,) for r in ratios], "deviation_ratio double")
    r = F.col("deviation_ratio")
    out = df.select(
        "deviation_ratio",
        rfm.health_status(r).alias("h"),
        F.when(r < 1.0, "Low").when(r.between(1.0, 2.0), "Medium").otherwise("High").alias("risk"),
    ).collect()
    got = {row.deviation_ratio: (row.h, row.risk) for row in out}
    assert got[0.99] == ("Active", "Low")
    assert got[1.0] == ("Active", "Medium")
    assert got[1.05] == ("Lapsed", "Medium")      # the (1.0, 1.1) gap falls through to Lapsed
    assert got[1.1] == ("Slipping", "Medium")
    assert got[2.0] == ("Slipping", "Medium")
    assert got[2.5] == ("Slipping", "High")
    assert got[2.51] == ("Lapsed", "High")
    assert got[None] == ("Lapsed", "High")


def _model(spark, lines):
    fact = spark.createDataFrame(
        lines, "OrderID long, ProductID long, CustomerID long, Quantity int, UnitPrice decimal(12,2), "
               "LastEditedWhen timestamp_ntz").withColumns({
                   "LastEditedDate": F.to_date("LastEditedWhen"), "active_flg": F.lit(1),
                   "SupplierId": F.lit(1).cast("long"), "customer_skey": F.lit("k")})
    cust = spark.createDataFrame([(c, "F", str(c), "X", "R", "S", 1, f"s{c}") for c in (1, 2, 3, 4)],
                                 "CustomerID long, CustomerFirstName string, CustomerLastName string, Country string, "
                                 "Region string, Segment string, active_flg int, skey string")
    prod = spark.createDataFrame([(1, "p", "B", Decimal("1.00"), 1, "k1")],
                                 "ProductID long, ProductName string, Brand string, UnitPrice decimal(12,2), "
                                 "active_flg int, skey string")
    sup = spark.createDataFrame([(1, "s", 1, "k")], "SupplierId long, SupplierName string, active_flg int, skey string")
    return GoldModel(spark, fact, prod, cust, sup)


def test_customer_segment_thresholds(spark):
    d0 = dt.datetime(2000, 1, 31)
    lines = [
        (1, 1, 1, 1, Decimal("10000.00"), d0), (2, 1, 1, 1, Decimal("0.01"), dt.datetime(2001, 1, 31)),   # 12 m, 10000.01
        (3, 1, 2, 1, Decimal("10000.00"), d0), (4, 1, 2, 1, Decimal("0.00"), dt.datetime(2001, 1, 31)),   # 12 m, 10000
        (5, 1, 3, 1, Decimal("90000.00"), d0), (6, 1, 3, 1, Decimal("1.00"), dt.datetime(2001, 1, 30)),   # 11 m
        (7, 1, 4, 1, Decimal("5.00"), d0),                                                               # one order
    ]
    r = {row.CustomerID: row for row in reports.customer_report(_model(spark, lines), DEFAULT).collect()}
    assert (r[1].customer_segment, r[1].life_span) == ("Loyal", 12)
    assert r[2].customer_segment == "Regular"
    assert (r[3].customer_segment, r[3].life_span) == ("New", 11)
    assert (r[4].customer_segment, r[4].avg_monthly_spend, r[4].avg_order_value) == ("New", 5.0, 5.0)
    assert r[1].avg_order_value == 5000.01  # round(10000.01 / 2, 2) half-up


def _naive(target, batch, now):
    out = [list(r) for r in target]
    active = {r[0]: r for r in out if r[3] == 1}
    for k, a, b in batch:
        cur = active.get(k)
        if cur is None:
            out.append([k, a, b, 1, now])
        elif cur[1] != a:          # type 2 column
            cur[3] = 0
            out.append([k, a, b, 1, now])
        elif cur[2] != b:          # type 1 column
            cur[2] = b
    return out


@pytest.mark.parametrize("seed", range(6))
def test_scd_random_batches_equal_naive_replay(spark, seed):
    rnd = random.Random(seed)
    snap, naive = None, []
    for step in range(3):
        now = dt.datetime(2024, 1, 1 + step)
        keys = rnd.sample(range(8), rnd.randint(1, 8))
        batch = [(k, rnd.choice(["x", "y", None]), rnd.choice(["p", "q", None])) for k in keys]
        df = spark.createDataFrame(batch, "k long, a string, b string")
        snap = (scd.initial_load(df, "k", ["b"], ["a"], now) if snap is None
                else scd.merge(snap, df, "k", ["b"], ["a"], now))
        snap = snap.cache()
        naive = _naive(naive, batch, now)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    got = sorted(((r.k, r.a, r.b, r.active_flg, r.effective_start_dt) for r in snap.collect()), key=key)
    want = sorted(((k, a, b, f, t) for k, a, b, f, t in naive), key=key)
    assert got == want
    assert snap.where("active_flg = 1").groupBy("k").count().where("count > 1").count() == 0


def test_optional_flags(spark):
    m = GoldModel.from_testdata(spark, "/root/testdata/sf0.001")
    exact = {r.CustomerID: r.total_orders for r in reports.customer_report(m, DEFAULT).collect()}
    approx = {r.CustomerID: r.total_orders for r in
              reports.customer_report(m, DEFAULT.with_(approx_distinct=True)).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[k] - exact[k]) <= max(2, 0.1 * exact[k]) for k in exact)
    lines = {r.CustomerID: r.Frequency for r in rfm.customer_activity(m, DEFAULT).collect()}
    orders = {r.CustomerID: r.Frequency for r in
              rfm.customer_activity(m, DEFAULT.with_(rfm_distinct_orders=True)).collect()}
    assert all(orders[k] <= lines[k] for k in lines) and sum(orders.values()) < sum(lines.values())
    labels = {r.Starting_Segment for r in
              rfm.migration_rates(m, DEFAULT.with_(migration_absent_label="Absent")).collect()}
    assert "Absent" in labels
