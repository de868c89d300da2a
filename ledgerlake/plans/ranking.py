"""Year-over-year, top-k and part-to-whole analytics.

The fact is first reduced per dimension key (ProductID / CustomerID, and
year where needed); only that aggregate meets the dimension table, so the
join input shrinks from order lines to products / customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ts_lit
from ..functions.money import exact_avg, sum_revenue, units
from ..model import GoldModel
from ..operators.share import share_pct, with_grand_total
from ..operators.topk import top_k_with_ties
from ..params import Params

# Comparison labels of the reference's year-over-year view.
AVG_CHANGE = ("Above Avg", "Below Avg", "Avg")
PY_CHANGE = ("Increase", "Decrease", "No Change")


def _revenue_by(m: GoldModel, key: str, extra=(), where=None) -> DataFrame:
    f = m.fact if where is None else m.fact.where(where)
    return f.groupBy(key, *extra).agg(sum_revenue().alias("rev"))


def _by_product_attr(m: GoldModel, attr: str, active_only: bool, extra=(), where=None) -> DataFrame:
    """SUM(revenue) per attribute of the active product versions; lines of
    other products go to NULL, or away with active_only."""
    per_prod = _revenue_by(m, "ProductID", extra, where)
    prods = m.active_products().select("ProductID", attr)
    joined = per_prod.join(prods, "ProductID", "inner" if active_only else "left")
    return joined.groupBy(attr, *extra).agg(F.sum("rev").alias("rev"))


# ------------------------------------------------------------------ K7 / K8 YoY

def _yoy(yearly: DataFrame, key: str, avg_scale: int) -> DataFrame:
    """Compare each year to the key's average year and to the previous
    *present* year (LAG over the rows that exist). The average is SQL AVG of
    the 2-decimal yearly revenue: rounded to 2 decimals (K7) or kept at
    Spark's AVG scale, 6 (K8) - both exact."""
    by_key = Window.partitionBy(key)
    by_key_year = Window.partitionBy(key).orderBy("order_year")
    cur = F.col("current_revenue")
    with_avg = yearly.withColumns({
        "__avg_units": F.sum(units("current_revenue")).over(by_key),
        "__avg_n": F.count("current_revenue").over(by_key),
    }).withColumn("avg_revenue", exact_avg("__avg_units", "__avg_n", 2, avg_scale))
    out = with_avg.withColumns({
        "diff_avg": cur - F.col("avg_revenue"),
        "py_revenue": F.lag("current_revenue").over(by_key_year),
    }).withColumn("diff_py", cur - F.col("py_revenue"))
    return out.select(
        "order_year", key,
        cur.cast("double").alias("current_revenue"),
        F.col("avg_revenue").cast("double").alias("avg_revenue"),
        F.col("diff_avg").cast("double").alias("diff_avg"),
        F.when(F.col("diff_avg") > 0, AVG_CHANGE[0]).when(F.col("diff_avg") < 0, AVG_CHANGE[1])
         .otherwise(AVG_CHANGE[2]).alias("avg_change"),
        F.col("py_revenue").cast("double").alias("py_revenue"),
        F.col("diff_py").cast("double").alias("diff_py"),
        F.when(F.col("diff_py") > 0, PY_CHANGE[0]).when(F.col("diff_py") < 0, PY_CHANGE[1])
         .otherwise(PY_CHANGE[2]).alias("py_change"),
    ).orderBy(key, "order_year")


def _yearly(m: GoldModel, p: Params, attr: str, active_only: bool) -> DataFrame:
    where = F.col("LastEditedWhen").isNotNull()
    if p.cutoff_date is not None:
        where = where & (F.col("LastEditedWhen") < ts_lit(p.cutoff_date))
    fact = m.fact.withColumn("order_year", F.year("LastEditedWhen"))
    m2 = GoldModel(m.spark, fact, m.products, m.customers, m.suppliers)
    by = _by_product_attr(m2, attr, active_only, extra=("order_year",), where=where)
    return by.select("order_year", attr, F.round("rev", 2).alias("current_revenue"))


def yoy_brand_revenue(m: GoldModel, p: Params) -> DataFrame:
    """K7: brand x year revenue vs the brand's (rounded) mean and vs the previous year."""
    return _yoy(_yearly(m, p, "Brand", active_only=False), "Brand", avg_scale=2)


def yoy_product_revenue(m: GoldModel, p: Params) -> DataFrame:
    """K8: same per ProductName over active products, unrounded mean
    (Spark's AVG scale for a 2-decimal input: 6)."""
    return _yoy(_yearly(m, p, "ProductName", active_only=True), "ProductName", avg_scale=6)


# ------------------------------------------------------------------ K9-K11 top-k

def _present_top(df: DataFrame, cols: list[str], rank_col: str) -> DataFrame:
    return df.select(*cols, F.round("rev", 2).cast("double").alias("total_revenue"), rank_col)


def top_brands(m: GoldModel, p: Params) -> DataFrame:
    """K9: brands with RANK() OVER (ORDER BY SUM(revenue) DESC) <= k (ties kept)."""
    by = _by_product_attr(m, "Brand", active_only=False)
    return _present_top(top_k_with_ties(by, "rev", p.top_brands, "rank_brands"), ["Brand"], "rank_brands")


def top_products(m: GoldModel, p: Params) -> DataFrame:
    """Product names (active products) ranked by revenue, ties kept."""
    by = _by_product_attr(m, "ProductName", active_only=True)
    return _present_top(top_k_with_ties(by, "rev", p.top_products, "rank_products"), ["ProductName"], "rank_products")


def top_customers(m: GoldModel, p: Params) -> DataFrame:
    """Customers ranked by revenue (left join: unknown customers kept)."""
    per = m.fact.groupBy("customer_skey", "CustomerID").agg(sum_revenue().alias("rev"))
    c = m.active_customers().select(F.col("CustomerID").alias("cid"), "CustomerFirstName", "CustomerLastName")
    joined = per.join(c, per["CustomerID"] == c["cid"], "left").select(
        "customer_skey", F.col("cid").alias("CustomerID"),
        F.concat(F.col("CustomerFirstName"), F.lit(" "), F.col("CustomerLastName")).alias("customer_name"), "rev")
    by = joined.groupBy("customer_skey", "CustomerID", "customer_name").agg(F.sum("rev").alias("rev"))
    ranked = top_k_with_ties(by, "rev", p.top_customers, "rank_customer")
    return _present_top(ranked, ["customer_skey", "CustomerID", "customer_name"], "rank_customer") \
        .orderBy(F.col("total_revenue").desc())


# ------------------------------------------------------------------ K12-K14 part-to-whole

def _part_to_whole(by: DataFrame, key: str) -> DataFrame:
    t = by.select(key, F.round("rev", 2).alias("total_revenue"))
    t = with_grand_total(t, "total_revenue", "overall_revenue")
    return t.select(
        key,
        F.col("total_revenue").cast("double").alias("total_revenue"),
        F.col("overall_revenue").cast("double").alias("overall_revenue"),
        share_pct("total_revenue", "overall_revenue").alias("percentage_of_total"),
    ).orderBy(F.col("total_revenue").desc())


def brands_part_to_whole(m: GoldModel, p: Params) -> DataFrame:
    """Brand revenue share of the total (total = sum of rounded brand totals)."""
    return _part_to_whole(_by_product_attr(m, "Brand", active_only=False), "Brand")


def product_part_to_whole(m: GoldModel, p: Params) -> DataFrame:
    """Product-name revenue share."""
    return _part_to_whole(_by_product_attr(m, "ProductName", active_only=False), "ProductName")


def country_part_to_whole(m: GoldModel, p: Params) -> DataFrame:
    """Customer-country revenue share (left join customers)."""
    per = _revenue_by(m, "CustomerID")
    c = m.active_customers().select("CustomerID", "Country")
    by = per.join(c, "CustomerID", "left").groupBy("Country").agg(F.sum("rev").alias("rev"))
    return _part_to_whole(by, "Country")
