"""Bind the driver's TPC-H-style tables to the gold star schema.

| gold        | built from                                  |
|-------------|---------------------------------------------|
| orders_fact | lineitem JOIN orders ON l_orderkey = o_orderkey (order-line grain) |
| products    | part                                        |
| customers   | customer JOIN nation JOIN region            |
| suppliers   | supplier                                    |

Only columns are renamed / typed here; every join and filter stays lazy so
Catalyst prunes columns and pushes predicates down to the parquet scans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import surrogate_key
from ..functions.money import MONEY, RATE, unit_price_from_extended
from ..operators.sizing import partitions, with_heads

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Version start stamped on the single (active) version of every test dimension row.
TESTDATA_VERSION_START = dt.datetime(1900, 1, 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _version_start() -> F.Column:
    return F.lit(TESTDATA_VERSION_START.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they are, without what their order says."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("l_linenumber").alias("LineNumber"),
        F.col("l_partkey").alias("ProductID"),
        F.col("l_suppkey").alias("SupplierId"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        unit_price_from_extended("l_extendedprice", "l_quantity").alias("UnitPrice"),
        F.col("l_tax").cast(RATE).alias("TaxRate"),
    )


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and time of each order."""
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("OrderID"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("LastEditedWhen"),
    )


def orders_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line fact. (OrderID, LineNumber) is NOT unique in the test data."""
    lines, heads = order_lines(spark, sf_dir), order_heads(spark, sf_dir)
    return (
        with_heads(lines, heads, partitions(lines, heads))
        .withColumns({
            "LastEditedDate": F.to_date("LastEditedWhen"),
            "active_flg": F.lit(1),
            "customer_skey": surrogate_key(F.col("CustomerID"), _version_start()),
            "product_skey": surrogate_key(F.col("ProductID"), _version_start()),
        })
    )


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the orders: one column of the order heads, which covers the fact."""
    return read_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("LastEditedDate"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ProductID"),
        F.col("p_name").alias("ProductName"),
        F.col("p_brand").alias("Brand"),
        F.col("p_type").alias("ProductType"),
        F.col("p_size").alias("Size"),
        F.col("p_retailprice").cast(MONEY).alias("UnitPrice"),
        F.lit(1).alias("active_flg"),
        surrogate_key(F.col("p_partkey"), _version_start()).alias("skey"),
        _version_start().alias("effective_start_dt"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    # TPC-H fixes nation at 25 rows and region at 5 rows at every scale
    # factor, so broadcasting them is bounded.
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left"))
    return (
        c.join(geo, c.c_nationkey == geo.n_nationkey, "left")
        .select(
            F.col("c_custkey").alias("CustomerID"),
            F.substring_index("c_name", "#", 1).alias("CustomerFirstName"),
            F.substring_index("c_name", "#", -1).alias("CustomerLastName"),
            F.col("n_name").alias("Country"),
            F.col("r_name").alias("Region"),
            F.col("c_mktsegment").alias("Segment"),
            F.lit(1).alias("active_flg"),
            surrogate_key(F.col("c_custkey"), _version_start()).alias("skey"),
            _version_start().alias("effective_start_dt"),
        )
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("SupplierId"),
        F.col("s_name").alias("SupplierName"),
        F.lit(1).alias("active_flg"),
        surrogate_key(F.col("s_suppkey"), _version_start()).alias("skey"),
        _version_start().alias("effective_start_dt"),
    )
