"""Run parameters.

The reference hard-codes ``GETDATE()`` and calendar years inside its views,
so its results drift with the wall clock. Every analytic here takes an
explicit ``as_of`` instead. The published thresholds are the defaults; the
``TESTDATA_*`` objects hold values that keep the segments non-degenerate on
the driver's synthetic tables (customer revenue there is 0.1M-5M per head).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    # "today" for recency / GETDATE() style measures (timestamp, midnight)
    as_of: dt.datetime = dt.datetime(2001, 8, 2)
    # K16 customer segments: life_span >= loyal_min_months and revenue > loyal_revenue
    loyal_min_months: int = 12
    loyal_revenue: float = 10000.0
    # K17 product report segments: > high, >= mid (inclusive)
    report_high_revenue: float = 50000.0
    report_mid_revenue: float = 10000.0
    # K18 product metrics segments: > high, > mid (exclusive)
    metrics_high_revenue: float = 50000.0
    metrics_mid_revenue: float = 20000.0
    # K22 migration
    anchor_year: int = 2001
    migration_else_label: str = "Standard"
    # K23 CLV
    clv_years: int = 3
    clv_retention: float = 0.9
    # optional order cut-off (B10): rows on/after this date are dropped
    cutoff_date: dt.date | None = None
    # F3 top-k sizes
    top_brands: int = 5
    top_products: int = 5
    top_customers: int = 10
    # NTILE buckets for RFM
    rfm_tiles: int = 5
    # M2 period comparison (inclusive year ranges) and M6 month comparison
    period_a: tuple[int, int] = (1995, 1997)
    period_b: tuple[int, int] = (1998, 2000)
    month_a: dt.date = dt.date(2001, 6, 1)
    month_b: dt.date = dt.date(2001, 7, 1)
    # M4 top brands by order count
    top_brands_by_orders: int = 3
    # Approximate distinct counts (HyperLogLog++) in the reports, for scale
    approx_distinct: bool = False
    # Q23: RFM Frequency / expected orders count order lines (as written) or distinct orders
    rfm_distinct_orders: bool = False
    # Q24: label of a customer absent from a migration period (None = the else-label)
    migration_absent_label: str | None = None
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()

# Thresholds scaled to the synthetic tables' revenue per customer/product
# (see SURVEY §1.5); lines per part / customer stay constant across sf.
TESTDATA_SCALED = Params(
    loyal_revenue=2_000_000.0,
    report_high_revenue=1_800_000.0,
    report_mid_revenue=1_400_000.0,
    metrics_high_revenue=1_800_000.0,
    metrics_mid_revenue=1_400_000.0,
)


def ts_literal(value: dt.datetime) -> str:
    return value.strftime("%Y-%m-%d %H:%M:%S")
