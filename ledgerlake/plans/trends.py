"""Change-over-time and cumulative analytics.

Shape of every plan: filter the fact early (pushed to the scan), aggregate
per *dimension key x period* first (partial aggregation, one row per key
and period leaves each task), join the - now small - aggregate to the
dimension, re-aggregate per attribute. The running totals use the
per-date rollup of ``operators.running`` instead of an un-partitioned
window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import trunc_ts, ts_lit
from ..functions.money import exact_avg, sum_revenue, units
from ..model import GoldModel
from ..operators.running import running_by_order
from ..params import Params


def _dated_fact(m: GoldModel, p: Params, active_only: bool = False) -> DataFrame:
    f = m.fact.where(F.col("LastEditedWhen").isNotNull())
    if active_only:
        f = f.where(F.col("active_flg") == 1)
    if p.cutoff_date is not None:
        f = f.where(F.col("LastEditedWhen") < ts_lit(p.cutoff_date))
    return f


def revenue_by_month(m: GoldModel, p: Params, active_only: bool = False, rounded: bool = False) -> DataFrame:
    """Monthly revenue, distinct customers and quantity."""
    f = _dated_fact(m, p, active_only)
    total = sum_revenue()
    if rounded:
        total = F.round(total, 2)
    return (
        f.groupBy(trunc_ts("month", "LastEditedWhen").alias("order_date"))
        .agg(
            total.cast("double").alias("total_revenue"),
            F.countDistinct("CustomerID").alias("total_customers"),
            F.sum("Quantity").cast("bigint").alias("total_quantity"),
        )
        .orderBy("order_date")
    )


def _period_aggs(prefix: str = "") -> list:
    """Partial sums that can be re-aggregated after a dimension join."""
    return [
        sum_revenue().alias(f"{prefix}rev"),
        F.sum(units("UnitPrice")).alias(f"{prefix}price_units"),
        F.count("UnitPrice").alias(f"{prefix}price_n"),
    ]


def _finish_period(df: DataFrame, keys: list[str]) -> DataFrame:
    """round(SUM(rev),2) and round(AVG(UnitPrice),2) from partial sums."""
    return df.groupBy(*keys).agg(
        F.round(F.sum("rev"), 2).alias("total_revenue"),
        F.sum("price_units").alias("price_units"),
        F.sum("price_n").alias("price_n"),
    ).withColumn("avg_price", exact_avg("price_units", "price_n", 2, 2)).drop("price_units", "price_n")


def _running(t: DataFrame, order: list[str], partition_by: list[str] | None, unique: bool = False) -> DataFrame:
    return running_by_order(
        t, order,
        sums={"running_total_revenue": "total_revenue"},
        avgs={"moving_average_price": "avg_price"},
        partition_cols=partition_by or (),
        unique_keys=unique,
    )


def _present(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    out = df.select(
        *cols,
        F.col("total_revenue").cast("double").alias("total_revenue"),
        F.col("running_total_revenue").cast("double").alias("running_total_revenue"),
        F.col("moving_average_price").cast("double").alias("moving_average_price"),
    )
    return out.orderBy(*order) if order else out


def cum_revenue(m: GoldModel, p: Params) -> DataFrame:
    """K2: yearly revenue with running total and expanding mean of yearly avg price."""
    f = _dated_fact(m, p)
    t = _finish_period(f.withColumn("order_date", trunc_ts("year", "LastEditedWhen"))
                       .groupBy("order_date").agg(*_period_aggs()), ["order_date"])
    return _present(_running(t, ["order_date"], None, unique=True), ["order_date"], ["order_date"])


def cum_revenue_by_brand(m: GoldModel, p: Params, partition_by_brand: bool = False) -> DataFrame:
    """K3: per brand and year. The running total is over *all* brands (the
    reference's ``OVER (ORDER BY order_date)`` has no PARTITION BY); set
    ``partition_by_brand`` for a per-brand running total."""
    f = _dated_fact(m, p).withColumn("order_date", trunc_ts("year", "LastEditedWhen"))
    per_product = f.groupBy("ProductID", "order_date").agg(*_period_aggs())
    prods = m.active_products().select("ProductID", "Brand")
    t = _finish_period(per_product.join(prods, "ProductID", "inner"), ["Brand", "order_date"])
    r = _running(t, ["order_date"], ["Brand"] if partition_by_brand else None)
    return _present(r, ["Brand", "order_date"], ["Brand", "order_date"])


def cum_revenue_by_country(m: GoldModel, p: Params, partition_by_country: bool = False) -> DataFrame:
    """K4: per customer country and year (running total over all countries)."""
    f = _dated_fact(m, p).withColumn("order_date", trunc_ts("year", "LastEditedWhen"))
    per_customer = f.groupBy("CustomerID", "order_date").agg(*_period_aggs())
    custs = m.active_customers().select("CustomerID", "Country")
    t = _finish_period(per_customer.join(custs, "CustomerID", "inner"), ["Country", "order_date"])
    r = _running(t, ["order_date"], ["Country"] if partition_by_country else None)
    return _present(r, ["Country", "order_date"], ["Country", "order_date"])


def cum_revenue_by_country_brand(m: GoldModel, p: Params) -> DataFrame:
    """K5: per country x brand x year; ``p.active_flg = 1`` turns the product
    left join into an inner join; customers stay a left join (NULL country
    kept); order dates before ``cutoff_date`` (None: no cut)."""
    f = _dated_fact(m, p).withColumn("order_date", trunc_ts("year", "LastEditedWhen"))
    prods = m.active_products().select("ProductID", "Brand")
    custs = m.active_customers().select("CustomerID", "Country")
    # reduce early: lines meet products (needed for the brand), then shrink to
    # customer x brand x year before the customer lookup
    per_cb = (f.join(prods, "ProductID", "inner")
              .groupBy("CustomerID", "Brand", "order_date").agg(*_period_aggs()))
    joined = per_cb.join(custs, "CustomerID", "left")
    t = _finish_period(joined, ["Country", "Brand", "order_date"])
    r = _running(t, ["order_date"], None)
    return _present(r, ["Country", "Brand", "order_date"], ["Brand", "order_date"])


def cum_revenue_monthly(m: GoldModel, p: Params) -> DataFrame:
    """K6: running revenue and expanding mean of the monthly (unrounded)
    average price, ordered by (year, month); fact ``active_flg = 1``.

    The monthly average keeps Spark's ``AVG(decimal(12,2))`` precision,
    ``decimal(16,6)``, computed exactly."""
    f = _dated_fact(m, p, active_only=True)
    t = (
        f.groupBy(trunc_ts("year", "LastEditedWhen").alias("order_year"),
                  trunc_ts("month", "LastEditedWhen").alias("order_month"))
        .agg(*_period_aggs())
        .select("order_year", "order_month", F.col("rev").alias("total_revenue"),
                exact_avg("price_units", "price_n", 2, 6).alias("avg_price"))
    )
    r = _running(t, ["order_year", "order_month"], None, unique=True)
    return r.select(
        "order_year", "order_month",
        F.col("running_total_revenue").cast("double").alias("running_total_revenue"),
        F.col("moving_average_price").cast("double").alias("moving_average_price"),
    )
