"""The layer jobs over the driver's tables.

Landing files are derived from the given tables, written as CSV into the
session's checkpoint folder, and taken through bronze, silver and gold by the
jobs themselves; every query returns rows of a layer.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs import medallion, runlog, tables
from ..jobs.stage import freed
from ..model import GoldModel
from ..operators import dq
from ..params import Params
from ..schemas import CUSTOMERS_CSV, ORDERS_CSV, PRODUCTS_CSV, SUPPLIERS_CSV
from ..session import checkpoint_dir
from ..sources.testdata import orders_fact, read_table
from ..streaming.ingest import start_dimension_stream
from . import ranking, reports

# Fixed values of the derived landing files: load times, the stamps that the
# files state, and which rows of the second file change or break.
LOADS = (dt.datetime(2001, 8, 2), dt.datetime(2001, 8, 3))
VALID_FROM, BAD_STAMP = "2001.08.01 13:30:00", "2001.13.01 13:30:00"
MOVED_ABOVE, CALLED_BELOW = 9000.0, 0.0
BAD_EVERY, KEYLESS_EVERY = 50, 77
LATE_EVERY, NEVER_EVERY = 5, 35


def lake(spark: SparkSession) -> str:
    """A new folder for one run's layers."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex}"


def _csv(df: DataFrame, schema, path: str) -> None:
    with freed(df.sparkSession):
        df.select(*schema.fieldNames()).write.option("header", "true").option("compression", "gzip").mode("append").csv(path)


def customer_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two landing files of customers. In the second, high balances have a new
    address, negative ones a new phone; every 50th row states a bad time and
    every 77th no id."""
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    base = c.join(F.broadcast(n.select("n_nationkey", "n_name")), c.c_nationkey == n.n_nationkey, "left").select(  # 25 nations at every scale
        key.cast("int").alias("CustomerID"), F.lit("Customer").alias("CustomerFirstName"), F.concat(F.lit("N"), text).alias("CustomerLastName"),
        F.concat(F.lit("555-"), text).alias("PhoneNumber"), F.concat(F.lit("556-"), text).alias("FaxNumber"),
        F.concat(F.lit("c"), text, F.lit("@example.org")).alias("Email"), F.concat(text, F.lit(" Main Street")).alias("Address"),
        F.col("c_mktsegment").alias("City"), F.lit("ST").alias("State"), F.col("c_nationkey").cast("string").alias("Zip"),
        F.coalesce("n_name", F.lit("none")).alias("Country"), F.lit(VALID_FROM).alias("ValidFrom"), F.lit(None).cast("string").alias("ValidTo"), "c_acctbal")
    bal, every = F.col("c_acctbal"), lambda k: F.col("CustomerID") % k == 0
    second = base.withColumns({
        "Address": F.when(bal > MOVED_ABOVE, F.concat(F.col("Address"), F.lit(" 2"))).otherwise(F.col("Address")),
        "PhoneNumber": F.when(bal < CALLED_BELOW, F.concat(F.col("PhoneNumber"), F.lit("-2"))).otherwise(F.col("PhoneNumber")),
        "ValidFrom": F.when(every(BAD_EVERY), F.lit(BAD_STAMP)).otherwise(F.col("ValidFrom"))}
    ).withColumn("CustomerID", F.when(~every(KEYLESS_EVERY), F.col("CustomerID")))
    return base, second


def _through(spark: SparkSession, root: str, table: str, path: str, now: dt.datetime) -> None:
    """One run of the three layers; the clocks of silver and gold play no part."""
    steps = (lambda: medallion.ingest_bronze(spark, root, table, path, now),
             lambda: medallion.build_silver(spark, root, table, now + dt.timedelta(hours=1)),
             lambda: medallion.merge_dimension(spark, root, table, now + dt.timedelta(hours=2)))
    for step in steps:
        result = step()
        if result.status != "success":
            raise ValueError(f"{table}: {result.status} {[r for r in result.dq or () if not r[-1]]}")


GOLD_COLUMNS = ["CustomerID", "CustomerLastName", "PhoneNumber", "Address", "Country", "active_flg", "effective_start_dt", "effective_end_dt", "update_dt", "skey"]


def etl_customers_gold(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Two customer loads from landing files to the gold dimension."""
    root = lake(spark)
    for file, now in zip(customer_files(spark, sf_dir), LOADS):
        _csv(file, CUSTOMERS_CSV, f"{root}/landing/{now:%d}")
        _through(spark, root, "customers", f"{root}/landing/{now:%d}", now)
    return medallion.read_dimension(spark, root, "customers").select(*GOLD_COLUMNS)


def etl_late_customers_gold(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """The same loads, both in bronze before silver and gold run: gold takes them in turn."""
    root = lake(spark)
    for file, now in zip(customer_files(spark, sf_dir), LOADS):
        _csv(file, CUSTOMERS_CSV, f"{root}/landing/{now:%d}")
        medallion.ingest_bronze(spark, root, "customers", f"{root}/landing/{now:%d}", now)
    medallion.build_silver(spark, root, "customers", LOADS[1])
    medallion.merge_dimension(spark, root, "customers", LOADS[1])
    return medallion.read_dimension(spark, root, "customers").select(*GOLD_COLUMNS)


def stream_customers_gold(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """The same files as a stream of landing files, drained twice."""
    root = lake(spark)
    clock = iter(LOADS)
    for file, now in zip(customer_files(spark, sf_dir), LOADS):
        _csv(file, CUSTOMERS_CSV, f"{root}/landing")
        start_dimension_stream(spark, root, "customers", f"{root}/landing", f"{root}/stream", clock=lambda: next(clock)).awaitTermination()
    return medallion.read_dimension(spark, root, "customers").select(*GOLD_COLUMNS)


def etl_quarantine(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Bad rows of the second customer file, as quarantine keeps them."""
    root = lake(spark)
    _csv(customer_files(spark, sf_dir)[1], CUSTOMERS_CSV, f"{root}/landing")
    medallion.ingest_bronze(spark, root, "customers", f"{root}/landing", LOADS[1])
    return medallion.read_quarantine(spark, root, "customers").select("raw_line", "Schema", "record_creation_date", "load")


def etl_run_log(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Run log of two loads and a replay, with the clean rows of each load; a
    replayed landing folder and an archived one add nothing."""
    root = lake(spark)
    for file, now in zip(customer_files(spark, sf_dir), LOADS):
        _csv(file, CUSTOMERS_CSV, f"{root}/landing/{now:%d}")
        for _ in range(2):
            medallion.ingest_bronze(spark, root, "customers", f"{root}/landing/*", now)
        medallion.archive_loaded(spark, root, "customers", f"{root}/archive", now)
        medallion.build_silver(spark, root, "customers", now)
    rows = medallion.read_bronze(spark, root, "customers").groupBy("load").agg(F.count("*").alias("clean_rows"))
    log = runlog.read(spark, f"{root}/log").select("Schema", "Table_name", "Status", "Created_at", F.col("version").alias("load"))
    return log.join(rows, "load", "left").select("Schema", "Table_name", "Status", "Created_at", "load", "clean_rows")


def _products_and_suppliers(spark: SparkSession, sf_dir: str, root: str, now: dt.datetime) -> None:
    """One load each, from landing files to gold."""
    none = F.lit(None).cast("string")
    part, supp = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "supplier")
    _csv(supp.select(F.col("s_suppkey").alias("SupplierId"), F.col("s_name").alias("SupplierName"), none.alias("PhoneNumber"), none.alias("Email"),
                     F.lit(VALID_FROM).alias("ValidFrom"), none.alias("ValidTo")), SUPPLIERS_CSV, f"{root}/landing/suppliers")
    _csv(part.select(F.col("p_partkey").alias("ProductID"), F.col("p_name").alias("ProductName"), none.alias("Color"), F.col("p_brand").alias("Brand"),
                     F.col("p_size").cast("string").alias("Size"), none.alias("Barcode"), F.lit("0.10").alias("TaxRate"),
                     F.col("p_retailprice").cast("decimal(12,2)").alias("UnitPrice"), none.alias("SupplierId"),
                     F.lit(VALID_FROM).alias("ValidFrom"), none.alias("ValidTo")), PRODUCTS_CSV, f"{root}/landing/products")
    for table in ("suppliers", "products"):
        _through(spark, root, table, f"{root}/landing/{table}", now)


def _order_file(spark: SparkSession, sf_dir: str, root: str, odd: int, at: dt.datetime) -> None:
    """Lines of odd (1) or even (0) orders as a landing file, taken into bronze."""
    lines = orders_fact(spark, sf_dir).where(F.col("LastEditedWhen").isNotNull()).select(
        "OrderID", "ProductID", "SupplierId", "CustomerID", "Quantity", "UnitPrice", "TaxRate", F.lit(1).alias("LastEditedBy"),
        F.date_format("LastEditedWhen", "yyyy.MM.dd HH:mm:ss").alias("LastEditedWhen"))
    _csv(lines.where(F.col("OrderID") % 2 == odd).sortWithinPartitions("OrderID"), ORDERS_CSV, f"{root}/landing/orders/{odd}")
    medallion.ingest_bronze(spark, root, "orders", f"{root}/landing/orders/{odd}", at)


def _order_layers(spark: SparkSession, root: str, now: dt.datetime) -> None:
    # lines of parts or suppliers that the tables don't hold would fail the contract, and a quantity of nothing silver's
    medallion.build_silver_orders(spark, root, now, checks=[])
    medallion.build_fact(spark, root, now=now, checks=[])


def etl_orders_gold(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Products, suppliers and customers (one load each) and order lines (two
    loads by odd and even order) from landing files to the gold fact."""
    root, now = lake(spark), LOADS[0]
    _csv(customer_files(spark, sf_dir)[0], CUSTOMERS_CSV, f"{root}/landing/customers")
    _through(spark, root, "customers", f"{root}/landing/customers", now)
    _products_and_suppliers(spark, sf_dir, root, now)
    for odd, at in zip((1, 0), LOADS):
        _order_file(spark, sf_dir, root, odd, at)
    _order_layers(spark, root, LOADS[1])
    f = medallion.read_fact(spark, root)
    return f.select("OrderID", "ProductID", "SupplierId", "CustomerID", "Quantity", F.col("UnitPrice").cast("double").alias("UnitPrice"), "LastEditedWhen",
                    "order_year", "date_skey", "product_skey", "supplier_skey", "customer_skey", "load", "insert_dt")


def etl_late_keys_fact(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Orders that arrive before their customers: odd orders are loaded while every
    ``LATE_EVERY``-th customer is missing; these follow, but for every ``NEVER_EVERY``-th,
    then their keys are filled in and the even orders are loaded."""
    root, customers, key = lake(spark), customer_files(spark, sf_dir)[0], F.col("CustomerID")
    files = (customers.where(key % LATE_EVERY != 0), customers.where((key % LATE_EVERY == 0) & (key % NEVER_EVERY != 0)))
    _products_and_suppliers(spark, sf_dir, root, LOADS[0])
    for odd, file, now in zip((1, 0), files, LOADS):
        _csv(file, CUSTOMERS_CSV, f"{root}/landing/{now:%d}")
        _through(spark, root, "customers", f"{root}/landing/{now:%d}", now)
        if not odd:
            medallion.fill_late_keys(spark, root, now)
        _order_file(spark, sf_dir, root, odd, now)
        _order_layers(spark, root, now)
    return medallion.read_fact(spark, root).select("OrderID", "CustomerID", "Quantity", "product_skey", "customer_skey", "load", "insert_dt", "update_dt")


# ---------------------------------------------------------------- catalog tables

def _tables(spark: SparkSession, sf_dir: str) -> GoldModel:
    """The gold layer as catalog tables of a new database, read back by name."""
    root = lake(spark)
    database = "gold_" + root.rsplit("-", 1)[1]
    tables.publish(GoldModel.from_testdata(spark, sf_dir), database, root)
    return tables.open_model(spark, database)


def etl_tables_customer_report(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """K16 over bucketed tables: customers' lines are added up where they lie."""
    return reports.customer_report(_tables(spark, sf_dir), p)


def etl_tables_top_10_customers(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """K11 over bucketed tables, through a view read back by name."""
    m = _tables(spark, sf_dir)
    view = "top_" + uuid.uuid4().hex
    ranking.top_customers(m, p).createOrReplaceTempView(view)
    return spark.table(view)


# ---------------------------------------------------------------- checks

def dq_landing_customers(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Every kind of check on the second customer file as it was parsed: types,
    order and presence of columns, row count, patterns, range, bound, length."""
    rows = customer_files(spark, sf_dir)[1]
    ts: Column = F.try_to_timestamp(F.col("ValidFrom"), F.lit("yyyy.MM.dd HH:mm:ss")).cast("timestamp_ntz")
    rows = rows.select("CustomerID", "CustomerLastName", "Email", "Address", ts.alias("ValidFrom"), F.col("c_acctbal").alias("Balance"))
    checks = [dq.Check("unique", "CustomerID"), dq.Check("not_null", "CustomerID"), dq.Check("not_null", "ValidFrom"), dq.Check("dtype", "CustomerID", {"type": "IntegerType"}),
              dq.Check("dtype", "Email", {"type": "IntegerType"}), dq.Check("column_exists", "Address"), dq.Check("column_exists", "Zip"),
              dq.Check("columns_ordered", None, {"columns": ["CustomerID", "CustomerLastName", "Email", "Address", "ValidFrom", "Balance"]}),
              dq.Check("columns_ordered", None, {"columns": ["Email", "CustomerID"]}), dq.Check("row_count", None, {"value": 1500}),
              dq.Check("regex", "Email", {"pattern": r"^c[0-9]*[02468]@example\.org$"}), dq.Check("regex", "ValidFrom", {"pattern": dq.TIMESTAMP_TEXT_PATTERN}),
              dq.Check("between", "CustomerID", {"min": 10, "max": 100}), dq.Check("greater_than", "Balance", {"value": 0}), dq.Check("max_length", "Address", {"size": 15})]
    return dq.run_checks(rows, checks)
