"""ETL operators run over the driver's tables.

These register the medallion building blocks as queries whose work grows
with the given tables: the calendar covering the fact, the fact with its
surrogate keys, latest-per-key dedupe, DQ results and an SCD1+2 merge of
the customer dimension with a second batch derived from the customer table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.medallion import assemble_fact
from ..model import GoldModel
from ..operators import calendar, dq, scd
from ..operators.dedupe import latest_per_key
from ..operators.sizing import partitions
from ..params import Params
from ..schemas import GOLD_CUSTOMERS_CONTRACT, ORDERS_FACT_CONTRACT
from ..sources import testdata

FACT_COLUMNS = ["OrderID", "LineNumber", "ProductID", "SupplierId", "CustomerID", "Quantity",
                "UnitPrice", "TaxRate", "LastEditedWhen", "LastEditedDate",
                "date_skey", "product_skey", "supplier_skey", "customer_skey"]


def dim_date(m: GoldModel, p: Params) -> DataFrame:
    """Calendar dimension over whole years covering the orders."""
    return m.dim_date


def report_calendar(m: GoldModel, p: Params) -> DataFrame:
    """Report calendar, first order date .. end of (last year + 5)."""
    return calendar.report_calendar(m.fact)


def orders_fact(m: GoldModel, p: Params) -> DataFrame:
    """Order lines with the four surrogate keys."""
    few = partitions(m.suppliers) <= 4  # 16 MB of files
    lines, heads = (m.fact, None) if m.parts is None else m.parts
    f = assemble_fact(lines, m.products, m.customers, m.suppliers, m.dim_date, few, ("CustomerID", "OrderID"), heads)
    return f.select(*[F.col(c).cast("double").alias(c) if c in ("UnitPrice", "TaxRate") else F.col(c)
                      for c in FACT_COLUMNS])


def latest_order_per_customer(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Latest order per customer (order date, then order key)."""
    o = testdata.read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def fact_dq_checks() -> list[dq.Check]:
    return [c for c in dq.contract_checks(ORDERS_FACT_CONTRACT, check_ordered_columns=False,
                                          enable_length_check=True)
            if c.kind in ("unique", "not_null", "max_length")]


def customer_dq_checks() -> list[dq.Check]:
    return [c for c in dq.contract_checks(GOLD_CUSTOMERS_CONTRACT, check_ordered_columns=False,
                                          enable_length_check=True)
            if c.kind in ("unique", "not_null", "max_length")]


def dq_orders_fact(m: GoldModel, p: Params) -> DataFrame:
    """I: data checks of the gold fact contract, one aggregate pass."""
    return dq.run_checks(orders_fact(m, p), fact_dq_checks())


def dq_customers(m: GoldModel, p: Params) -> DataFrame:
    """I: data checks of the gold customer contract."""
    return dq.run_checks(m.customers, customer_dq_checks())


# ---------------------------------------------------------------- SCD1+2 over the customer table

SCD_KEY = "CustomerID"
SCD_T1 = ["Segment"]
SCD_T2 = ["CustomerFirstName", "CustomerLastName", "Country"]
SCD_LOAD_1 = dt.datetime(2001, 8, 2)
SCD_LOAD_2 = dt.datetime(2001, 8, 3)
# Fixed values of the derived second batch: the account-balance bands that
# change the segment (type 1), the country (type 2) or both.
SEGMENT_CHANGE_BELOW = 0.0
COUNTRY_CHANGE_ABOVE = 9000.0
BOTH_CHANGE_BAND = (8000.0, 9000.0)
CHANGED_SEGMENT = "AUTOMOBILE"


def scd_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(initial customer snapshot, second batch). The second batch moves
    customers with a balance above 9000 to the next nation (type 2), sets
    the segment of negative balances to AUTOMOBILE (type 1) and does both
    for balances in [8000, 9000]."""
    c = testdata.read_table(spark, sf_dir, "customer")
    n = testdata.read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # TPC-H: 25 nations at every scale factor
    nat = F.broadcast(n)
    base = c.join(nat, c.c_nationkey == nat.n_nationkey, "left").select(
        F.col("c_custkey").alias("CustomerID"),
        F.substring_index("c_name", "#", 1).alias("CustomerFirstName"),
        F.substring_index("c_name", "#", -1).alias("CustomerLastName"),
        F.col("n_name").alias("Country"), F.col("c_mktsegment").alias("Segment"),
        "c_acctbal", "c_nationkey")
    nxt = F.broadcast(n.select(F.col("n_nationkey").alias("__nk"), F.col("n_name").alias("__next")))
    lo, hi = BOTH_CHANGE_BAND
    bal = F.col("c_acctbal")
    seg_change = (bal < SEGMENT_CHANGE_BELOW) | bal.between(lo, hi)
    ctry_change = (bal > COUNTRY_CHANGE_ABOVE) | bal.between(lo, hi)
    b2 = (base.join(nxt, (F.col("c_nationkey") + 1) % 25 == F.col("__nk"), "left")
          .withColumns({"Segment": F.when(seg_change, F.lit(CHANGED_SEGMENT)).otherwise(F.col("Segment")),
                        "Country": F.when(ctry_change, F.col("__next")).otherwise(F.col("Country"))}))
    cols = [SCD_KEY, *SCD_T2, *SCD_T1]
    return base.select(*cols), b2.select(*cols)


def customers_scd2(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Initial load, then merge of the derived batch (type 1 + type 2)."""
    b1, b2 = scd_batches(spark, sf_dir)
    target = scd.initial_load(b1, SCD_KEY, SCD_T1, SCD_T2, SCD_LOAD_1)
    merged = scd.merge(target, b2, SCD_KEY, SCD_T1, SCD_T2, SCD_LOAD_2)
    return merged.select(SCD_KEY, "Country", "Segment", "active_flg",
                         "effective_start_dt", "effective_end_dt", "update_dt", "skey")
