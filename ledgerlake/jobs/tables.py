"""The gold layer as catalog tables with stated partitions and buckets.

``publish`` writes a model's tables under ``root`` and names them in ``database``;
``open_model`` reads them back by name. ``LAYOUT`` states each table's key: its rows are
bucketed by the key's hash, so the catalog knows where a key lies. Joins of order lines
to customers and aggregates by CustomerID then run on the buckets as they lie, without a
shuffle of the lines; the fact is partitioned by ``order_year`` besides, for pruning.

Rows are dealt to the writing tasks by ranges of (year, bucket, order). A customer with a
third of all lines is thereby written by many tasks, as several files of one bucket. A
read that uses the buckets takes a bucket in one task: there are as many as the fact's
size asks for, unless ``buckets`` states a number; read with ``spark.sql.sources.bucketing.enabled`` off where one
customer alone is too large (Spark then shuffles, and AQE splits what is skewed).

Tables that exist are replaced; an empty model gives empty tables. NULL keys are a bucket
like any other, and lines without a time stand in the year folder of NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GoldModel
from ..operators.sizing import partitions

BUCKETS = 16  # at least; more for larger tables (``sizing``)

# table -> (bucket key, partition column)
LAYOUT = {
    "orders_fact": ("CustomerID", "order_year"),
    "customers": ("CustomerID", None),
    "products": ("ProductID", None),
    "suppliers": ("SupplierId", None),
    "dim_date": (None, None),
}


def _frames(model: GoldModel) -> dict[str, DataFrame]:
    fact = model.fact if "order_year" in model.fact.columns else model.fact.withColumn("order_year", F.year("LastEditedWhen"))
    return {"orders_fact": fact, "customers": model.customers, "products": model.products, "suppliers": model.suppliers, "dim_date": model.dim_date}


def publish(model: GoldModel, database: str, root: str, buckets: int | None = None) -> None:
    """Write the model as tables of ``database``, each in its folder under ``root``."""
    spark, root = model.spark, root.rstrip("/")
    if buckets is None:
        buckets = max(BUCKETS, partitions(model.fact))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}'")
    for name, df in _frames(model).items():
        key, part = LAYOUT[name]
        if key is not None:
            bucket = F.pmod(F.hash(key), F.lit(buckets))  # as Spark's own buckets
            spread = [part, bucket, "OrderID"] if part else [bucket]
            df = df.repartitionByRange(partitions(df), *spread)  # a task sorts its rows: as many as the size asks for
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{root}/{name}")
        if part is not None:
            writer = writer.partitionBy(part)
        if key is not None:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")


def open_model(spark: SparkSession, database: str) -> GoldModel:
    """The tables of ``database`` as a model, read by name."""
    t = {name: spark.table(f"{database}.{name}") for name in LAYOUT}
    return GoldModel(spark, t["orders_fact"], t["products"], t["customers"], t["suppliers"], _dim_date=t["dim_date"])
