"""Registered analytics (names follow SURVEY §2 keys)."""

from __future__ import annotations

import datetime as dt

from . import oracle as O
from . import trends
from .catalog import REGISTRY, register
from ..params import DEFAULT

# K1 / K1b
register("revenue_by_month", lambda m, p: trends.revenue_by_month(m, p), lambda p: O.revenue_by_month(p))
register("revenue_by_month_active",
         lambda m, p: trends.revenue_by_month(m, p, active_only=True, rounded=True),
         lambda p: O.revenue_by_month(p, active_only=True, rounded=True))
# K2-K6
register("cum_revenue", trends.cum_revenue, O.cum_revenue)
register("cum_revenue_by_brand", trends.cum_revenue_by_brand, O.cum_revenue_by_brand)
register("cum_revenue_by_country", trends.cum_revenue_by_country, O.cum_revenue_by_country)
register("cum_revenue_by_country_brand", trends.cum_revenue_by_country_brand, O.cum_revenue_by_country_brand)
register("cum_revenue_monthly", trends.cum_revenue_monthly, O.cum_revenue_monthly)

from . import ranking  # noqa: E402

# K7-K8
register("yoy_brand_revenue", ranking.yoy_brand_revenue, O.yoy_brand_revenue)
register("yoy_product_revenue", ranking.yoy_product_revenue, O.yoy_product_revenue)
# K9-K11
register("top_5_brands", ranking.top_brands, O.top_brands)
register("top_5_products", ranking.top_products, O.top_products)
register("top_10_customers", ranking.top_customers, O.top_customers)
# K12-K14
register("brands_part_to_whole", ranking.brands_part_to_whole, O.brands_part_to_whole)
register("country_part_to_whole", ranking.country_part_to_whole, O.country_part_to_whole)
register("product_part_to_whole", ranking.product_part_to_whole, O.product_part_to_whole)

from . import reports, rfm  # noqa: E402
from ..params import TESTDATA_SCALED  # noqa: E402

# K15-K18 (published thresholds, and thresholds scaled to the test data)
register("customer_report", reports.customer_report, O.customer_report)
register("customer_report_scaled", reports.customer_report, O.customer_report, TESTDATA_SCALED)
register("segment_part_to_whole", reports.segment_part_to_whole, O.segment_part_to_whole)
register("segment_part_to_whole_scaled", reports.segment_part_to_whole, O.segment_part_to_whole, TESTDATA_SCALED)
register("product_report", reports.product_report, O.product_report)
register("product_report_scaled", reports.product_report, O.product_report, TESTDATA_SCALED)
register("product_metrics", reports.product_metrics, O.product_metrics)
register("product_metrics_scaled", reports.product_metrics, O.product_metrics, TESTDATA_SCALED)
# M7
register("revenue_by_product_segment", reports.revenue_by_product_segment, O.revenue_by_product_segment)
register("customers_by_product_segment", reports.customers_by_product_segment, O.customers_by_product_segment)
# K19-K21, K25
register("rfm_segments", rfm.rfm_segments, O.rfm_segments)
register("rfm_segment_counts", rfm.rfm_segment_counts, O.rfm_segment_counts)
register("rfm_churn", rfm.rfm_churn, O.rfm_churn)
register("max_order_date", rfm.max_order_date, O.max_order_date)
# K22 (else-label 'Standard' and 'Regular' variants of the two reference scripts)
register("migration_rates", rfm.migration_rates, O.migration_rates)
register("migration_rates_regular", rfm.migration_rates, O.migration_rates,
         DEFAULT.with_(migration_else_label="Regular"))
# K23-K24b, M8
register("clv_forecast", rfm.clv_forecast, O.clv_forecast)
register("clv_risk_adjusted", rfm.clv_risk_adjusted, O.clv_risk_adjusted)
register("clv_risk_adjusted_raw", lambda m, p: rfm.clv_risk_adjusted(m, p, rounded=False),
         lambda p: O.clv_risk_adjusted(p, rounded=False))
register("customers_by_risk_and_status", rfm.customers_by_risk_and_status, O.customers_by_risk_and_status)

from . import kpi  # noqa: E402

# L1-L4
register("kpi_base", kpi.kpi_base, O.kpi_base)
register("kpi_base_by_brand", lambda m, p: kpi.kpi_base(m, p, by="brand"), lambda p: O.kpi_base(p, by="brand"))
register("kpi_base_by_month", lambda m, p: kpi.kpi_base(m, p, by="month"), lambda p: O.kpi_base(p, by="month"))
register("kpi_base_by_region", lambda m, p: kpi.kpi_base(m, p, by="region"), lambda p: O.kpi_base(p, by="region"))
register("kpi_current_vs_prior_year", kpi.kpi_current_vs_prior_year, O.kpi_current_vs_prior_year)
register("kpi_yoy_pct_by_brand", kpi.kpi_yoy_pct_by_brand, O.kpi_yoy_pct_by_brand)
register("mom_indicator", kpi.mom_indicator, O.mom_indicator)
# M1-M6
register("revenue_by_year", kpi.revenue_by_year, O.revenue_by_year)
register("orders_by_year", kpi.orders_by_year, O.orders_by_year)
register("revenue_by_year_brand", kpi.revenue_by_year_brand, O.revenue_by_year_brand)
register("brand_period_change", kpi.brand_period_change, O.brand_period_change)
register("orders_aov_by_month", kpi.orders_aov_by_month, O.orders_aov_by_month)
register("orders_aov_by_month_top_brands", kpi.orders_aov_by_month_top_brands, O.orders_aov_by_month_top_brands)
register("orders_aov_revenue_by_region_month", kpi.orders_aov_revenue_by_region_month,
         O.orders_aov_revenue_by_region_month)
register("decline_drivers", kpi.decline_drivers, O.decline_drivers)

from . import etl  # noqa: E402

# J3, J7, J8, J10, J12, I
register("dim_date", etl.dim_date, O.dim_date)
register("report_calendar", etl.report_calendar, O.report_calendar)
register("orders_fact", etl.orders_fact, O.orders_fact)
register("latest_order_per_customer", None, O.latest_order_per_customer, raw=etl.latest_order_per_customer)
register("dq_orders_fact", etl.dq_orders_fact, O.dq_orders_fact)
register("dq_customers", etl.dq_customers, O.dq_customers)
register("customers_scd2", None, O.customers_scd2, raw=etl.customers_scd2)

# A calendar without weekends drops the orders of those days and no others
register("customer_report_business_days", lambda m, p: reports.customer_report(m.on_days("not IsWeekend"), p),
         lambda p: O.customer_report(p, days="(SELECT * FROM dim_date WHERE isodow(date) < 6)"))
# Lines from the cut-off on are dropped before the windows
_CUT = DEFAULT.with_(cutoff_date=dt.date(1999, 1, 1))
register("yoy_brand_revenue_until_1998", ranking.yoy_brand_revenue, lambda p: O.before(O.yoy_brand_revenue(p), "1999-01-01"), _CUT)
register("cum_revenue_monthly_until_1998", trends.cum_revenue_monthly, lambda p: O.before(O.cum_revenue_monthly(p), "1999-01-01"), _CUT)

from . import etl_jobs  # noqa: E402

# The jobs from landing files of the given tables to gold
register("etl_customers_gold", None, O.etl_customers_gold, raw=etl_jobs.etl_customers_gold)
register("etl_late_customers_gold", None, O.etl_customers_gold, raw=etl_jobs.etl_late_customers_gold)
register("stream_customers_gold", None, O.etl_customers_gold, raw=etl_jobs.stream_customers_gold)
register("etl_quarantine", None, O.etl_quarantine, raw=etl_jobs.etl_quarantine)
register("etl_run_log", None, O.etl_run_log, raw=etl_jobs.etl_run_log)
register("etl_orders_gold", None, O.etl_orders_gold, raw=etl_jobs.etl_orders_gold)
register("etl_late_keys_fact", None, O.etl_late_keys_fact, raw=etl_jobs.etl_late_keys_fact)
register("etl_tables_customer_report", None, O.customer_report, raw=etl_jobs.etl_tables_customer_report)
register("etl_tables_top_10_customers", None, O.top_customers, raw=etl_jobs.etl_tables_top_10_customers)
register("dq_landing_customers", None, O.dq_landing_customers, raw=etl_jobs.dq_landing_customers)

# The same analytics over dimensions that also hold closed versions: one revenue, not one per version
_HISTORY = ("cum_revenue_by_country_brand", "yoy_brand_revenue", "top_5_brands", "top_10_customers", "brands_part_to_whole",
            "country_part_to_whole", "product_part_to_whole", "kpi_base_by_brand", "kpi_base_by_region", "kpi_yoy_pct_by_brand",
            "revenue_by_year_brand", "brand_period_change", "orders_aov_by_month_top_brands", "orders_aov_revenue_by_region_month", "decline_drivers")
for _name in _HISTORY:
    _e = REGISTRY[_name]
    register(f"{_name}_history", lambda m, p, build=_e.build: build(m.with_closed_versions(), p), _e.oracle, _e.params)
