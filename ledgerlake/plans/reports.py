"""Customer and product reports.

The reference groups by the dimension's attributes after joining every
order line to the dimension. All of those attributes depend on the
dimension key alone (one active row per key), so the fact is aggregated
per key *first* and the much smaller per-key result is joined to the
dimension - same rows, the join input shrinks from lines to keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_diff, ts_lit
from ..functions.money import exact_avg, half_up_div, money_from_cents, revenue_cents, sum_revenue, units
from ..model import GoldModel
from ..operators.distinct import MERGE, two_distinct_counts
from ..operators.share import share_pct
from ..operators.sizing import partitions
from ..params import Params

# Segment labels of the reference's report rules, in rule order.
CUSTOMER_SEGMENTS = ("Loyal", "Regular", "New")
PRODUCT_SEGMENTS = ("High-Performer", "Mid-Range", "Low-Performer")


def _measures(fact: DataFrame, keys: list[str], second: tuple[str, str], p: Params, **more: Column) -> DataFrame:
    """Orders, distinct values of ``second``, revenue, quantity, first and last
    order date and the sums ``more`` per keys; the two distinct counts are exact,
    or HyperLogLog++ estimates when ``p.approx_distinct``."""
    aggs = {"__cents": ("sum", revenue_cents()), "total_quantity": ("sum", F.col("Quantity").cast("bigint")),
            "last_order_date": ("max", F.col("LastEditedWhen")), "first_order_date": ("min", F.col("LastEditedWhen")),
            **{name: ("sum", c) for name, c in more.items()}}
    if p.approx_distinct:
        per = fact.groupBy(*keys).agg(F.approx_count_distinct("OrderID").alias("total_orders"), F.approx_count_distinct(second[0]).alias(second[1]),
                                      *[MERGE[how](c).alias(name) for name, (how, c) in aggs.items()])
    else:
        per = two_distinct_counts(fact, keys, ("OrderID", "total_orders"), second, aggs)
    return per.withColumn("total_revenue", money_from_cents(F.col("__cents")))


def _money(c: str) -> Column:
    return F.col(c).cast("double").alias(c)


def _ratio_round2(num: str, den: str) -> Column:
    """round(num / den, 2) for a 2-decimal ``num``, exact half-up."""
    return (half_up_div(f"cast({num} * 100 as decimal(38,0))", den).cast("decimal(38,0)") / 100).cast("decimal(38,2)")


# ------------------------------------------------------------------ K16 customers

def customer_base(m: GoldModel, p: Params) -> DataFrame:
    """Per customer metrics over calendar-matched orders of active customers."""
    f = m.fact_in_calendar()
    per = _measures(f, ["CustomerID"], ("ProductID", "total_products"), p)
    c = m.active_customers().select(
        F.col("skey").alias("customer_key"), "CustomerID",
        F.concat(F.col("CustomerFirstName"), F.lit(" "), F.col("CustomerLastName")).alias("customer_name"))
    return per.join(c.hint("shuffle_hash"), "CustomerID", "inner").withColumn(
        "life_span", month_diff("first_order_date", "last_order_date"))


def customer_report(m: GoldModel, p: Params) -> DataFrame:
    """One row per active customer with segment, recency and spend ratios."""
    b = customer_base(m, p)
    rev, life = F.col("total_revenue"), F.col("life_span")
    loyal, regular, new = CUSTOMER_SEGMENTS
    segment = (F.when((life >= p.loyal_min_months) & (rev > p.loyal_revenue), loyal)
               .when((life >= p.loyal_min_months) & (rev <= p.loyal_revenue), regular)
               .otherwise(new))
    return b.select(
        "customer_key", "CustomerID", "customer_name",
        segment.alias("customer_segment"),
        "last_order_date",
        month_diff("last_order_date", ts_lit(p.as_of)).alias("recency"),
        "total_orders", _money("total_revenue"), "total_quantity", "total_products", "life_span",
        F.when(F.col("total_orders") > 0, _ratio_round2("total_revenue", "total_orders"))
         .otherwise(F.lit(0)).cast("double").alias("avg_order_value"),
        F.when(life > 0, _ratio_round2("total_revenue", "life_span"))
         .otherwise(rev).cast("double").alias("avg_monthly_spend"),
    )


def segment_part_to_whole(m: GoldModel, p: Params) -> DataFrame:
    """Revenue share per customer segment. The final window runs over
    at most three rows (one per segment label)."""
    r = customer_report(m, p)
    seg = r.groupBy("customer_segment").agg(
        F.count("total_products").alias("total_products"),
        F.round(F.sum(F.col("total_revenue").cast("decimal(38,2)")), 2).alias("total_revenue"),
        F.round(F.sum(F.col("avg_monthly_spend").cast("decimal(38,2)")), 2).alias("total_avg_monthly_spend"),
    )
    whole = Window.partitionBy(F.lit(1))
    return seg.select(
        "customer_segment", "total_products",
        _money("total_revenue"), _money("total_avg_monthly_spend"),
        share_pct("total_revenue", F.sum("total_revenue").over(whole)).alias("percentage_of_total"),
        F.rank().over(Window.orderBy(F.col("total_revenue").desc())).alias("rank_customer"),
    )


# ------------------------------------------------------------------ K17 / K18 products

BUYERS = ("CustomerID", "total_customers")


def product_report(m: GoldModel, p: Params) -> DataFrame:
    """Per active product, dimension price; Mid-Range is >= mid threshold."""
    f = m.fact.where(F.col("OrderID").isNotNull())
    # selling price of a line = revenue / quantity; with a decimal(12,2) price
    # round(q * p, 2) / q is p itself, so its cents are summed (long) over the
    # lines with a non-zero quantity and averaged exactly
    line_sp = F.when(F.col("Quantity") != 0, units("UnitPrice"))
    per = _measures(f, ["ProductID"], BUYERS, p, __sp_sum=line_sp, __sp_n=line_sp.isNotNull().cast("long"))
    prods = m.active_products().select("ProductID", "ProductName", "UnitPrice")
    b = per.join(prods.hint("shuffle_hash"), "ProductID", "inner").withColumn(
        "lifespan", month_diff("first_order_date", "last_order_date"))
    rev = F.col("total_revenue")
    high, mid, low = PRODUCT_SEGMENTS
    segment = (F.when(rev > p.report_high_revenue, high)
               .when(rev >= p.report_mid_revenue, mid).otherwise(low))
    asp = (half_up_div("__sp_sum", "__sp_n * 10").cast("decimal(38,0)") / 10).cast("decimal(38,1)")
    return b.select(
        "ProductID", "ProductName", _money("UnitPrice"), "last_order_date",
        month_diff("last_order_date", ts_lit(p.as_of)).alias("recency_in_months"),
        segment.alias("product_segment"),
        "lifespan", "total_orders", _money("total_revenue"), "total_quantity", "total_customers",
        asp.cast("double").alias("avg_selling_price"),
        F.when(F.col("total_orders") == 0, F.lit(0))
         .otherwise(_ratio_round2("total_revenue", "total_orders")).cast("double").alias("avg_order_revenue"),
        F.when(F.col("lifespan") == 0, rev)
         .otherwise(_ratio_round2("total_revenue", "lifespan")).cast("double").alias("avg_monthly_revenue"),
    )


def product_metrics_base(m: GoldModel, p: Params, tasks: int | None = None) -> DataFrame:
    """Per (active product, *fact* unit price) aggregates (K18 grain), joined to the
    products in ``tasks`` tasks for a caller that hashes the result (default: the session's)."""
    per = _measures(m.fact, ["ProductID", "UnitPrice"], BUYERS, p, __pu=units("UnitPrice"), __pn=F.col("UnitPrice").isNotNull().cast("long"))
    prods = m.active_products().select("ProductID", "ProductName", "Brand")
    if tasks:
        per, prods = per.repartition(tasks, "ProductID"), prods.repartition(tasks, "ProductID")
    return per.join(prods.hint("shuffle_hash"), "ProductID", "inner").withColumns({
        "life_span": month_diff("first_order_date", "last_order_date"),
        "average_price": exact_avg("__pu", "__pn", 2, 2),
    })


def _metrics_segment(p: Params) -> Column:
    rev = F.col("total_revenue")
    high, mid, low = PRODUCT_SEGMENTS
    return (F.when(rev > p.metrics_high_revenue, high)
            .when((rev > p.metrics_mid_revenue) & (rev <= p.metrics_high_revenue), mid)
            .otherwise(low))


def product_metrics(m: GoldModel, p: Params) -> DataFrame:
    """One row per product *price point*; Mid-Range is > mid threshold;
    the two ratios are unrounded (double)."""
    b = product_metrics_base(m, p)
    rev = F.col("total_revenue")
    return b.select(
        "ProductID", "ProductName", "Brand", _money("UnitPrice"), "last_order_date",
        month_diff("last_order_date", ts_lit(p.as_of)).alias("recency"),
        _metrics_segment(p).alias("product_segment"),
        "life_span", "total_orders", _money("total_revenue"), "total_quantity", "total_customers",
        _money("average_price"),
        F.when(F.col("total_orders") == 0, F.lit(0.0))
         .otherwise(rev.cast("double") / F.col("total_orders")).alias("Average_order_revenue"),
        F.when(F.col("life_span") == 0, rev.cast("double"))
         .otherwise(rev.cast("double") / F.col("life_span")).alias("Average_monthly_revenue"),
    )


# ------------------------------------------------------------------ M7

def revenue_by_product_segment(m: GoldModel, p: Params) -> DataFrame:
    """M7: products, price points and revenue per K18 product segment. Every task hashes
    its distinct products, so the tasks are as many as the fact's size asks for."""
    b = product_metrics_base(m, p, partitions(m.fact)).withColumn("product_segment", _metrics_segment(p))
    return b.groupBy("product_segment").agg(
        F.countDistinct("ProductID").alias("products"),
        F.count(F.lit(1)).alias("price_points"),
        F.round(F.sum("total_revenue"), 2).cast("double").alias("total_revenue"),
    )


def customers_by_product_segment(m: GoldModel, p: Params) -> DataFrame:
    """M7: distinct customers buying from each K18 product segment.

    The price points' totals decide the segments; the fact is read again for
    the customers rather than written out at that grain."""
    triples = m.fact.groupBy("ProductID", "UnitPrice", "CustomerID").agg(sum_revenue().alias("rev"))
    points = triples.groupBy("ProductID", "UnitPrice").agg(F.sum("rev").alias("total_revenue"))
    prods = m.active_products().select("ProductID")
    seg = (points.join(prods, "ProductID", "inner")
           .select("ProductID", "UnitPrice", _metrics_segment(p).alias("product_segment")))
    return (triples.join(seg, ["ProductID", "UnitPrice"], "inner")
            .groupBy("product_segment")
            .agg(F.countDistinct("CustomerID").alias("customers")))
