"""KPI tables re-expressed from the DAX measures, and narrative rollups
(SURVEY L1-L4, M1-M6).

DAX measures are evaluated per slice of a report; here each becomes a
grouped table over the slice columns. ``DIVIDE`` (blank on 0) is a NULL-on-0
division. "Current year" is the last year present in the fact (the DAX
``MAX(DateTBL[Year])`` would point at the forecast end of the calendar).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import trunc_ts, ts_lit
from ..functions.money import money_from_cents, revenue_cents, sum_revenue
from ..model import GoldModel
from ..operators.sizing import partitions
from ..operators.topk import top_k_with_ties
from ..params import Params
from ..operators.share import attach_scalars

# The three indicator glyphs of the month-over-month measure
# (UNICHAR 9610, 9650, 9660).
MOM_NEUTRAL = "▊"
MOM_UP = "▲"
MOM_DOWN = "▼"


def divide(num: Column, den: Column) -> Column:
    """DAX DIVIDE: NULL when the denominator is 0 or NULL (double)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def _kpi_cols(rev="gross_revenue", orders="orders", qty="quantities") -> list[Column]:
    r, o, q = F.col(rev), F.col(orders), F.col(qty)
    return [
        r.cast("double").alias("gross_revenue"), o.alias("orders"), q.alias("quantities"),
        divide(q, o).alias("items_per_order"),
        divide(r, q).alias("avo"),
        divide(r, q).alias("asp"),
        divide(r, o).alias("revenue_per_order"),
    ]


def _brands(m: GoldModel) -> DataFrame:
    """Brand per product."""
    return m.active_products().select("ProductID", "Brand")


def _brand_orders(m: GoldModel, brands: DataFrame, how: str, **keys: Column) -> DataFrame:
    """Cents and quantity of the fact per Brand, ``keys`` and OrderID; the products are
    the hashed side, so the lines of a task pass by unsorted.

    A count of distinct orders behind the join would hash nearly every line of a task, in
    as many tasks as the session has, so both shuffles have partitions by the fact's size."""
    n = partitions(m.fact)
    lines = m.fact.select("ProductID", "OrderID", *[c.alias(name) for name, c in keys.items()],
                          revenue_cents().alias("__cents"), F.col("Quantity").cast("bigint").alias("__quantity"))
    sold = lines.repartition(n, "ProductID").join(brands.repartition(n, "ProductID").hint("shuffle_hash"), "ProductID", how)
    group = ["Brand", *keys, "OrderID"]
    return sold.select(*group, "__cents", "__quantity").repartition(n, *group).groupBy(*group).agg(
        F.sum("__cents").alias("__cents"), F.sum("__quantity").alias("__quantity"))


def _order_sums(revenue: str, orders: str, quantity: str) -> list[Column]:
    """The sums of ``_brand_orders`` under their names; its rows are distinct orders."""
    return [money_from_cents(F.sum("__cents")).alias(revenue), F.count("OrderID").alias(orders), F.sum("__quantity").cast("bigint").alias(quantity)]


def _base_aggs() -> list[Column]:
    return [sum_revenue().alias("gross_revenue"),
            F.countDistinct("OrderID").alias("orders"),
            F.sum("Quantity").cast("bigint").alias("quantities")]


def kpi_base(m: GoldModel, p: Params, by: str = "year") -> DataFrame:
    """L1: Gross Revenue, Orders, Quantities, Items per Order, AVO, ASP per slice.

    ``by``: ``year`` | ``month`` | ``brand`` | ``region``.
    """
    f = m.fact
    if by == "year":
        g = f.groupBy(F.year("LastEditedWhen").alias("order_year")).agg(*_base_aggs())
        keys = ["order_year"]
    elif by == "month":
        g = f.groupBy(trunc_ts("month", "LastEditedWhen").alias("order_month")).agg(*_base_aggs())
        keys = ["order_month"]
    elif by == "brand":
        g = _brand_orders(m, _brands(m), "left").groupBy("Brand").agg(*_order_sums("gross_revenue", "orders", "quantities"))
        keys = ["Brand"]
    elif by == "region":
        # one row per customer and order, so that distinct orders are counted per region
        per = f.groupBy("CustomerID", "OrderID").agg(sum_revenue().alias("gross_revenue"), F.sum("Quantity").alias("quantities"))
        g = (per.join(m.active_customers().select("CustomerID", "Region"), "CustomerID", "left")
             .groupBy("Region", "OrderID").agg(F.sum("gross_revenue").alias("gross_revenue"), F.sum("quantities").alias("quantities"))
             .groupBy("Region").agg(F.sum("gross_revenue").alias("gross_revenue"),
                                    F.count("OrderID").alias("orders"),
                                    F.sum("quantities").cast("bigint").alias("quantities")))
        keys = ["Region"]
    else:
        raise ValueError(by)
    return g.select(*keys, *_kpi_cols())


def _cy_ly(per_year: DataFrame, keys: list[str]) -> DataFrame:
    """Current (last) year vs the calendar year before, from a per-(slice,
    year) aggregate. The last year is a scalar subquery that reads every column
    of the aggregate, so that it is the same exchange as the rows' and reused."""
    rest = [c for c in per_year.columns if c not in (*keys, "__y")]
    last = per_year.agg(F.max("__y").alias("current_year"), *[F.count(c).alias(f"__n_{c}") for c in rest])
    j = attach_scalars(per_year, last)
    cy = F.col("__y") == F.col("current_year")
    ly = F.col("__y") == F.col("current_year") - 1
    g = j.groupBy(*keys, "current_year").agg(
        F.sum(F.when(cy, F.col("gross_revenue"))).alias("cy_revenue"),
        F.coalesce(F.sum(F.when(cy, F.col("orders"))), F.lit(0)).alias("cy_orders"),
        F.sum(F.when(cy, F.col("quantities"))).cast("bigint").alias("cy_quantities"),
        F.sum(F.when(ly, F.col("gross_revenue"))).alias("ly_revenue"),
        F.coalesce(F.sum(F.when(ly, F.col("orders"))), F.lit(0)).alias("ly_orders"),
        F.sum(F.when(ly, F.col("quantities"))).cast("bigint").alias("ly_quantities"),
    )
    return g.select(*keys, "current_year", *_cy_ly_cols())


def _cy_ly_cols() -> list[Column]:
    cy_avo = divide(F.col("cy_revenue"), F.col("cy_quantities"))
    ly_avo = divide(F.col("ly_revenue"), F.col("ly_quantities"))
    return [
        F.col("cy_revenue").cast("double").alias("cy_revenue"), "cy_orders", cy_avo.alias("cy_avo"),
        F.col("ly_revenue").cast("double").alias("ly_revenue"), "ly_orders", ly_avo.alias("ly_avo"),
        divide(F.col("cy_revenue") - F.col("ly_revenue"), F.col("ly_revenue")).alias("revenue_yoy_pct"),
        divide(F.col("cy_orders") - F.col("ly_orders"), F.col("ly_orders")).alias("orders_yoy_pct"),
        divide(cy_avo - ly_avo, ly_avo).alias("avo_yoy_pct"),
    ]


def kpi_current_vs_prior_year(m: GoldModel, p: Params) -> DataFrame:
    """L2 + L3: current (last) year vs the calendar year before, whole fact."""
    per = m.fact.groupBy(F.year("LastEditedWhen").alias("__y")).agg(*_base_aggs())
    return _cy_ly(per, [])


def kpi_yoy_pct_by_brand(m: GoldModel, p: Params) -> DataFrame:
    """L3 sliced by brand: (CY - LY) / LY with the global last year."""
    per = (_brand_orders(m, _brands(m), "left", __y=F.year("LastEditedWhen"))
           .groupBy("Brand", "__y").agg(*_order_sums("gross_revenue", "orders", "quantities")))
    return _cy_ly(per, ["Brand"])


def mom_indicator(m: GoldModel, p: Params) -> DataFrame:
    """L4: revenue vs the previous *calendar* month (blank if that month has
    no sales) with the DAX glyphs. One row per month: the row before it counts
    if it is the month before."""
    monthly = m.fact.groupBy(trunc_ts("month", "LastEditedWhen").alias("order_month")).agg(sum_revenue().alias("revenue"))
    w = Window.orderBy("order_month")  # the window spans the calendar's months, not the data
    adjacent = F.lag("order_month").over(w) == F.timestamp_add("MONTH", F.lit(-1), F.col("order_month"))
    j = monthly.withColumn("prev_month_revenue", F.when(adjacent, F.lag("revenue").over(w)))
    cur, pm = F.col("revenue"), F.col("prev_month_revenue")
    ind = (F.when(pm.isNull(), MOM_NEUTRAL).when(cur > pm, MOM_UP).when(cur < pm, MOM_DOWN).otherwise(MOM_NEUTRAL))
    return j.select("order_month", cur.cast("double").alias("revenue"),
                    pm.cast("double").alias("prev_month_revenue"), ind.alias("mom_change"))


# ------------------------------------------------------------------ M1-M6 rollups

def _yearly_change(df: DataFrame, value: str, prev: str, pct: str) -> DataFrame:
    # one row per year: the window spans the calendar's years, not the data
    w = Window.orderBy("order_year")
    v = F.col(value)
    return df.withColumn(prev, F.lag(value).over(w)).withColumn(
        pct, F.round((v - F.col(prev)).cast("double") / F.nullif(F.col(prev).cast("double"), F.lit(0.0)) * 100, 2))


def revenue_by_year(m: GoldModel, p: Params) -> DataFrame:
    """M1: yearly revenue and % change vs the previous present year."""
    g = m.fact.groupBy(F.year("LastEditedWhen").alias("order_year")).agg(
        sum_revenue().alias("total_revenue"))
    r = _yearly_change(g, "total_revenue", "prev_revenue", "revenue_change_pct")
    return r.select("order_year", F.col("total_revenue").cast("double").alias("total_revenue"),
                    F.col("prev_revenue").cast("double").alias("prev_revenue"), "revenue_change_pct")


def orders_by_year(m: GoldModel, p: Params) -> DataFrame:
    """M1: yearly distinct orders and % change."""
    g = m.fact.groupBy(F.year("LastEditedWhen").alias("order_year")).agg(
        F.countDistinct("OrderID").alias("total_orders"))
    return _yearly_change(g, "total_orders", "prev_orders", "orders_change_pct")


def revenue_by_year_brand(m: GoldModel, p: Params) -> DataFrame:
    """M2: year x brand revenue (fact reduced per product first)."""
    per = m.fact.groupBy("ProductID", F.year("LastEditedWhen").alias("order_year")).agg(
        sum_revenue().alias("rev"))
    g = (per.join(m.active_products().select("ProductID", "Brand"), "ProductID", "left")
         .groupBy("order_year", "Brand").agg(F.round(F.sum("rev"), 2).alias("total_revenue")))
    return g.select("order_year", "Brand", F.col("total_revenue").cast("double").alias("total_revenue"))


def brand_period_change(m: GoldModel, p: Params) -> DataFrame:
    """M2: brand revenue in two year ranges and the % change between them."""
    (a0, a1), (b0, b1) = p.period_a, p.period_b
    y = F.year("LastEditedWhen")
    lo, hi = min(a0, b0), max(a1, b1)
    f = m.fact_between(dt.datetime(lo, 1, 1), dt.datetime(hi + 1, 1, 1))
    per = f.groupBy("ProductID").agg(
        sum_revenue(y.between(a0, a1)).alias("ra"),
        sum_revenue(y.between(b0, b1)).alias("rb"))
    g = (per.join(m.active_products().select("ProductID", "Brand"), "ProductID", "left")
         .groupBy("Brand").agg(F.sum("ra").alias("ra"), F.sum("rb").alias("rb")))
    return g.select(
        "Brand",
        F.col("ra").cast("double").alias("revenue_period_a"),
        F.col("rb").cast("double").alias("revenue_period_b"),
        F.round(divide(F.col("rb") - F.col("ra"), F.col("ra")) * 100, 2).alias("change_pct"),
    )


def _order_kpis() -> list[Column]:
    return [F.countDistinct("OrderID").alias("total_orders"),
            sum_revenue().alias("total_revenue"),
            F.sum("Quantity").cast("bigint").alias("total_quantity")]


def _order_kpi_cols() -> list[Column]:
    return ["total_orders", F.col("total_revenue").cast("double").alias("total_revenue"), "total_quantity",
            divide(F.col("total_revenue"), F.col("total_quantity")).alias("avo"),
            divide(F.col("total_revenue"), F.col("total_orders")).alias("revenue_per_order")]


def orders_aov_by_month(m: GoldModel, p: Params) -> DataFrame:
    """M3: monthly orders, revenue and average values."""
    g = m.fact.groupBy(trunc_ts("month", "LastEditedWhen").alias("order_month")).agg(*_order_kpis())
    return g.select("order_month", *_order_kpi_cols())


def orders_aov_by_month_top_brands(m: GoldModel, p: Params) -> DataFrame:
    """M4: monthly orders / AOV for the top brands by distinct orders (ties kept).

    Two reads of the fact: the first ranks the brands, the second joins only
    the products of the top ones, so most lines go before the shuffle."""
    # lines of unknown products (NULL brand) do not compete as a brand
    prods = _brands(m).where(F.col("Brand").isNotNull())
    by_brand = _brand_orders(m, prods, "inner").groupBy("Brand").agg(F.count("OrderID").alias("brand_orders"))
    top = top_k_with_ties(by_brand, "brand_orders", p.top_brands_by_orders, "brand_rank")
    # ties can keep more than k brands, so the list is not hinted as broadcast
    keep = top.select(F.col("Brand").alias("__b"))
    sel = _brand_orders(m, prods.join(keep, prods["Brand"] == keep["__b"], "left_semi"), "inner", order_month=trunc_ts("month", "LastEditedWhen"))
    g = sel.groupBy("Brand", "order_month").agg(*_order_sums("total_revenue", "total_orders", "total_quantity"))
    return g.select("Brand", "order_month", *_order_kpi_cols())


def orders_aov_revenue_by_region_month(m: GoldModel, p: Params) -> DataFrame:
    """M5: region x month orders, AOV (region from nation/region)."""
    # one row per customer, month and order, so that distinct orders are counted per region
    per = (m.fact.groupBy("CustomerID", trunc_ts("month", "LastEditedWhen").alias("order_month"), "OrderID")
           .agg(sum_revenue().alias("total_revenue"), F.sum("Quantity").alias("total_quantity")))
    g = (per.join(m.active_customers().select("CustomerID", "Region"), "CustomerID", "left")
         .groupBy("Region", "order_month", "OrderID").agg(F.sum("total_revenue").alias("total_revenue"), F.sum("total_quantity").alias("total_quantity"))
         .groupBy("Region", "order_month").agg(F.count("OrderID").alias("total_orders"),
                                               F.sum("total_revenue").alias("total_revenue"),
                                               F.sum("total_quantity").cast("bigint").alias("total_quantity")))
    return g.select("Region", "order_month", *_order_kpi_cols())


def decline_drivers(m: GoldModel, p: Params) -> DataFrame:
    """M6: each brand's revenue change between two months and its share of
    the total change."""
    ma, mb = p.month_a, p.month_b
    month = trunc_ts("month", "LastEditedWhen")
    a_ts, b_ts = ts_lit(ma), ts_lit(mb)
    lo, hi = min(ma, mb), max(ma, mb)
    nxt = dt.datetime(hi.year + (hi.month == 12), hi.month % 12 + 1, 1)
    f = m.fact_between(dt.datetime(lo.year, lo.month, 1), nxt)
    per = f.groupBy("ProductID").agg(
        sum_revenue(month == a_ts).alias("ra"),
        sum_revenue(month == b_ts).alias("rb"))
    g = (per.join(m.active_products().select("ProductID", "Brand"), "ProductID", "left")
         .groupBy("Brand").agg(F.coalesce(F.sum("ra"), F.lit(0)).alias("ra"),
                               F.coalesce(F.sum("rb"), F.lit(0)).alias("rb"))
         .withColumn("chg", F.col("rb") - F.col("ra")))
    total = g.agg(F.sum("chg").alias("__tot"))
    return attach_scalars(g, total).select(
        "Brand",
        F.col("ra").cast("double").alias("revenue_month_a"),
        F.col("rb").cast("double").alias("revenue_month_b"),
        F.col("chg").cast("double").alias("revenue_change"),
        F.round(divide(F.col("chg"), F.col("__tot")) * 100, 2).alias("share_of_change_pct"),
    ).orderBy("revenue_change")
