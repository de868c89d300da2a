"""RFM scoring, churn health, CLV and segment migration.

One per-customer aggregate feeds everything; the three quintile scores come
from the exact keys at which the tiles begin (``operators.cuts``) rather
than from ``NTILE() OVER (ORDER BY ...)``, which would sort every customer in
one task. CustomerID breaks ties so the scores are deterministic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_months_ts, day_diff, ts_lit
from ..functions.money import exact_avg, half_up_div, revenue_cents, sum_revenue
from ..model import GoldModel
from ..operators.cuts import ntiles
from ..operators.share import attach_scalars
from ..params import Params
from ..session import materialize

# Segment and status labels of the reference's rules, in rule order.
RFM_SEGMENTS = ("VIP Customers", "Loyal Customers", "New Customers", "At Risk", "Other")
CHURN_SEGMENTS = ("VIP Customers", "AT risk Giant Customers", "Promising New Customers", "Regular Customers")
HEALTH_STATUS = ("Active", "Slipping", "Lapsed")
RISK_CATEGORIES = ("Low", "Medium", "High")
MIGRATION_SEGMENTS = ("Loyal", "At Risk")  # the third label is a parameter (Standard / Regular)


def customer_activity(m: GoldModel, p: Params) -> DataFrame:
    """Per-customer Recency / Frequency / Monetary and purchase-gap inputs."""
    asof = ts_lit(p.as_of)
    # Q23: the reference counts order *lines*; optionally distinct orders
    n = F.countDistinct("OrderID") if p.rfm_distinct_orders else F.count("OrderID")
    return m.fact.groupBy("CustomerID").agg(
        day_diff(F.max("LastEditedDate"), asof).alias("Recency"),
        n.alias("Frequency"),
        sum_revenue().alias("Monetary"),
        day_diff(F.max("LastEditedWhen"), asof).alias("days_since_last_purchase"),
        (day_diff(F.min("LastEditedWhen"), F.max("LastEditedWhen"))
         / F.nullif(n - 1, F.lit(0))).alias("avg_purchase_gap"),
    )


def scored(m: GoldModel, p: Params) -> DataFrame:
    """Customer activity with R/F/M quintile scores."""
    # one row per customer; written once, as the jobs that look for the cuts read it several times
    a = materialize(customer_activity(m, p))
    return ntiles(a, p.rfm_tiles, {"R_Score": ("Recency", True), "F_Score": ("Frequency", False), "M_Score": ("Monetary", False)}, tie="CustomerID")


def _rfm_segment(r: Column, f: Column, m: Column) -> Column:
    vip, loyal, new, at_risk, other = RFM_SEGMENTS
    return (F.when((r == 5) & (f == 5) & (m == 5), vip)
            .when((r >= 4) & (f >= 4), loyal)
            .when((r == 5) & (f == 1), new)
            .when(r <= 2, at_risk)
            .otherwise(other))


def rfm_segments(m: GoldModel, p: Params) -> DataFrame:
    """CustomerID, RFM_Cell ('543'), Customer_Segment."""
    s = scored(m, p)
    r, f, mm = F.col("R_Score"), F.col("F_Score"), F.col("M_Score")
    return s.select(
        "CustomerID",
        F.concat(r.cast("string"), f.cast("string"), mm.cast("string")).alias("RFM_Cell"),
        _rfm_segment(r, f, mm).alias("Customer_Segment"),
    )


def rfm_segment_counts(m: GoldModel, p: Params) -> DataFrame:
    """Customers per RFM segment."""
    return rfm_segments(m, p).groupBy("Customer_Segment").agg(F.count(F.lit(1)).alias("customer_count"))


def deviation_ratio() -> Column:
    """Current silence / typical gap; 0.5 for single-purchase customers."""
    gap = F.col("avg_purchase_gap")
    return F.when(gap.isNull(), F.lit(0.5)).otherwise(
        F.col("days_since_last_purchase").cast("double") / F.nullif(gap, F.lit(0.0)))


def health_status(ratio: Column) -> Column:
    # (1.0, 1.1) and NULL fall through to Lapsed, exactly as written in SQL
    active, slipping, lapsed = HEALTH_STATUS
    return F.when(ratio <= 1.0, active).when(ratio.between(1.1, 2.5), slipping).otherwise(lapsed)


def rfm_churn(m: GoldModel, p: Params) -> DataFrame:
    """RFM segment x health status. Both labels come from the same
    per-customer row (no self-join); NULL CustomerID is dropped as the
    reference's inner join on CustomerID does."""
    s = scored(m, p).where(F.col("CustomerID").isNotNull())
    r, f = F.col("R_Score"), F.col("F_Score")
    vip, giant, promising, regular = CHURN_SEGMENTS
    seg = (F.when((r > 4) & (f > 4), vip)
           .when((r <= 2) & (f >= 4), giant)
           .when((r >= 4) & (f <= 2), promising)
           .otherwise(regular))
    t = s.select("CustomerID", "M_Score", seg.alias("customer_segment"),
                 health_status(deviation_ratio()).alias("health_status"))
    return t.groupBy("customer_segment", "health_status").agg(
        F.count("CustomerID").alias("customer_count"),
        (half_up_div("sum(M_Score) * 100", "count(M_Score)").cast("decimal(38,0)") / 100)
        .cast("double").alias("avg_monetary_tier"),
        F.sum(F.when(F.col("health_status") == "Slipping", 1).otherwise(0)).cast("bigint")
        .alias("intervention_needed_count"),
    ).orderBy("customer_segment", "health_status")


def max_order_date(m: GoldModel, p: Params) -> DataFrame:
    """Latest order timestamp."""
    return m.fact.agg(F.max("LastEditedWhen").alias("MaxDate"))


# ------------------------------------------------------------------ CLV

def clv_forecast(m: GoldModel, p: Params) -> DataFrame:
    """(avg line value x orders per year) x years, plus a discounted
    variant with annuity factor (1 - r^n) / (1 - r)."""
    base = m.fact.groupBy("CustomerID").agg(
        F.min("LastEditedWhen").alias("first_purchase"),
        F.max("LastEditedWhen").alias("last_purchase"),
        F.countDistinct("OrderID").alias("total_orders"),
        F.sum(revenue_cents()).alias("__rev_units"),
        F.count(revenue_cents()).alias("__rev_n"),
    ).withColumn("avg_order_value", exact_avg("__rev_units", "__rev_n", 2, 2))
    days = day_diff("first_purchase", "last_purchase")
    freq = F.col("total_orders").cast("double") / F.nullif(days, F.lit(0)) * 365
    value = F.col("avg_order_value").cast("double") * freq
    r, n = p.clv_retention, p.clv_years
    return base.select(
        "CustomerID",
        (value * n).alias("predicted_3yr_clv"),
        (value * F.expr(f"(1 - power({r}, {n}))") / F.expr(f"(1 - {r})")).alias("discounted_3yr_clv"),
    )


def clv_risk(m: GoldModel, p: Params) -> DataFrame:
    a = customer_activity(m, p).withColumn("deviation_ratio", deviation_ratio())
    ratio = F.col("deviation_ratio")
    return a.withColumns({
        "risk_category": F.when(ratio < 1.0, RISK_CATEGORIES[0]).when(ratio.between(1.0, 2.0), RISK_CATEGORIES[1])
                          .otherwise(RISK_CATEGORIES[2]),
        "health_status": health_status(ratio),
        "survival_prob": F.when(ratio <= 1.0, F.lit(1.0)).when(ratio > 3.0, F.lit(0.1))
                          .otherwise(F.lit(1.0) / ratio),
    }).withColumn("expected_orders_raw", F.col("Frequency") * F.col("survival_prob"))


def clv_risk_adjusted(m: GoldModel, p: Params, rounded: bool = True) -> DataFrame:
    """Churn-risk adjusted expected orders."""
    a = clv_risk(m, p)
    exp = F.round("expected_orders_raw") if rounded else F.col("expected_orders_raw")
    return a.select("CustomerID", "deviation_ratio", "risk_category", "survival_prob",
                    exp.cast("double").alias("adjusted_expected_orders_yr"))


def customers_by_risk_and_status(m: GoldModel, p: Params) -> DataFrame:
    """M8: customers and expected orders per risk category x health status,
    with the share of all customers."""
    a = clv_risk(m, p).where(F.col("CustomerID").isNotNull())
    g = a.groupBy("risk_category", "health_status").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum(F.round("expected_orders_raw")).alias("expected_orders"),
    )
    # both columns, so that the subquery reads the exchange of the rows
    total = g.agg(F.sum("customer_count").alias("__all"), F.count("expected_orders").alias("__cells"))
    return attach_scalars(g, total).select(
        "risk_category", "health_status", "customer_count",
        F.col("expected_orders").cast("double").alias("expected_orders"),
        F.round(F.col("customer_count").cast("double") / F.col("__all") * 100, 2).alias("pct_customers"),
    )


# ------------------------------------------------------------------ K22 migration

def _segment(recency: str, orders: str, else_label: str) -> Column:
    loyal, at_risk = MIGRATION_SEGMENTS
    return (F.when((F.col(recency) <= 30) & (F.col(orders) > 5), loyal)
            .when(F.col(recency) > 90, at_risk).otherwise(else_label))


def migration_rates(m: GoldModel, p: Params) -> DataFrame:
    """Segment flow between [max-6m, max-3m) and [max-3m, max].

    ``customer_orders`` is one row per customer and order *day* (the
    reference groups by the day's recency). The reference then FULL JOINs
    the two periods on CustomerID, pairing every period-1 day with every
    period-2 day of a customer. Those pairs are counted without being
    built: per customer and segment the day counts n1, n2 are aggregated
    (at most 3 x 3 rows per customer) and a pair cell adds n1 * n2; a
    customer present in one period only pairs with the else-label.
    """
    label = p.migration_else_label
    absent = p.migration_absent_label or label
    asof = ts_lit(p.as_of)
    # both reads are cut to the years they need (year folders prune)
    y0, y1 = dt.datetime(p.anchor_year, 1, 1), dt.datetime(p.anchor_year + 1, 1, 1)
    maxd = m.fact_between(y0, y1).agg(F.max("LastEditedWhen").alias("MaxDate"))
    days = (m.fact_in_calendar(m.fact_between(dt.datetime(p.anchor_year - 1, 7, 1), y1)).groupBy("CustomerID", "LastEditedDate")
            .agg(F.countDistinct("OrderID").alias("total_orders"), F.max("LastEditedWhen").alias("last_order_date")))
    c = m.active_customers().select("CustomerID")
    per_day = (days.join(c, "CustomerID", "left_semi")
               .withColumn("recency", day_diff(F.col("LastEditedDate"), asof)))
    tagged = attach_scalars(per_day, maxd)  # one-row scalar
    lo6, lo3, last = add_months_ts("MaxDate", -6), add_months_ts("MaxDate", -3), F.col("last_order_date")
    period = F.when((last >= lo6) & (last < lo3), 1).when((last >= lo3) & (last <= F.col("MaxDate")), 2)
    counted = (tagged.withColumn("period", period).where("period is not null")
               .groupBy("CustomerID", "period", _segment("recency", "total_orders", label).alias("s")).agg(F.count(F.lit(1)).alias("n")))
    # at most three segments per customer and period; one row stands for an absent period
    none = F.array(F.struct(F.lit(absent).alias("s"), F.lit(1).cast("long").alias("n")))
    held = lambda k: F.filter("held", lambda x: x["period"] == k)
    side = lambda k: F.when(F.size(held(k)) > 0, F.transform(held(k), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n")))).otherwise(none)
    per_customer = counted.groupBy("CustomerID").agg(F.collect_list(F.struct("period", "s", "n")).alias("held"))
    pairs = (per_customer.select(side(1).alias("p1"), side(2).alias("p2"))
             .select(F.explode("p1").alias("x"), "p2").select("x", F.explode("p2").alias("y"))
             .select(F.col("x.s").alias("Starting_Segment"), F.col("y.s").alias("Ending_Segment"), (F.col("x.n") * F.col("y.n")).alias("pairs")))
    counts = pairs.groupBy("Starting_Segment", "Ending_Segment").agg(
        F.sum("pairs").cast("bigint").alias("Customer_Count"))
    # at most nine rows: pairs of three labels
    with_tot = counts.withColumn("__start_total", F.sum("Customer_Count").over(Window.partitionBy("Starting_Segment")))
    return with_tot.select(
        "Starting_Segment", "Ending_Segment", "Customer_Count",
        (F.col("Customer_Count").cast("double") / F.col("__start_total").cast("double") * 100)
        .alias("Migration_Rate_Pct"),
    ).orderBy("Starting_Segment", F.col("Migration_Rate_Pct").desc())
