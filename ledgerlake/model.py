"""The gold star schema as a bundle of lazy DataFrames.

Every analytic takes a ``GoldModel`` and returns a DataFrame; nothing is
collected. A model comes either from the driver's test tables
(``from_testdata``) or from gold tables written by the ETL jobs
(``from_parquet``), where the fact is partitioned by order year.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from .operators.calendar import dim_date_covering
from .sources import testdata


@dataclass
class GoldModel:
    spark: SparkSession
    fact: DataFrame
    products: DataFrame
    customers: DataFrame
    suppliers: DataFrame
    _dim_date: DataFrame | None = None
    #: (lines, heads) that ``fact`` joins by order, where the source holds them apart
    parts: tuple[DataFrame, DataFrame] | None = None

    @property
    def dim_date(self) -> DataFrame:
        """The calendar of the layer, or one of whole years covering the orders."""
        if self._dim_date is None:
            self._dim_date = dim_date_covering(self.fact)
        return self._dim_date

    def active_products(self) -> DataFrame:
        return self.products.where(F.col("active_flg") == 1)

    def active_customers(self) -> DataFrame:
        return self.customers.where(F.col("active_flg") == 1)

    def fact_between(self, lo: dt.datetime | None = None, hi: dt.datetime | None = None) -> DataFrame:
        """Fact rows with ``lo <= LastEditedWhen < hi``. On a materialised
        gold fact the same range is also stated on the ``order_year``
        partition column, so whole year folders are skipped at planning."""
        f = self.fact
        ts = F.col("LastEditedWhen")
        if lo is not None:
            f = f.where(ts >= F.lit(lo.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))
            if "order_year" in f.columns:
                f = f.where(F.col("order_year") >= lo.year)
        if hi is not None:
            f = f.where(ts < F.lit(hi.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))
            if "order_year" in f.columns:
                last_year = hi.year if (hi.month, hi.day, hi.hour, hi.minute, hi.second) != (1, 1, 0, 0, 0) else hi.year - 1
                f = f.where(F.col("order_year") <= last_year)
        return f

    def fact_in_calendar(self, fact: DataFrame | None = None) -> DataFrame:
        """``dim_date JOIN orders_fact ON LastEditedDate = date`` (C6): order lines
        of the days that the calendar holds. Over a fact partitioned by
        ``order_year`` the join also states the year, so Spark prunes year
        folders by the calendar's rows at run time (the lower bound, which every
        date keeps, marks the calendar as a side worth pruning by)."""
        days = self.dim_date.where(F.expr("date >= DATE'0001-01-01'")).select(F.col("date").alias("__day"), F.year("date").alias("__year"))
        fact = self.fact if fact is None else fact
        on = fact["LastEditedDate"] == days["__day"]
        if "order_year" in fact.columns:
            on = on & (fact["order_year"] == days["__year"])
        return fact.join(F.broadcast(days), on, "inner").drop("__day", "__year")  # a row per day of its years

    def on_days(self, keep) -> "GoldModel":
        """The same model over a calendar that holds only the days for which ``keep`` (a column) is true."""
        return GoldModel(self.spark, self.fact, self.products, self.customers, self.suppliers, self.dim_date.where(keep))

    def with_closed_versions(self) -> "GoldModel":
        """The same model with a closed earlier version of every dimension row
        with an even key, as a second load leaves behind."""
        def add(dim: DataFrame, key: str, changed: str) -> DataFrame:
            closed = dim.where(F.col(key) % 2 == 0).withColumns({
                "active_flg": F.lit(0), changed: F.concat(F.lit("closed "), F.col(changed)), "skey": F.sha2(F.concat(F.col("skey"), F.lit("~closed")), 256)})
            return dim.unionByName(closed)
        return GoldModel(self.spark, self.fact, add(self.products, "ProductID", "Brand"), add(self.customers, "CustomerID", "Country"),
                         add(self.suppliers, "SupplierId", "SupplierName"), self._dim_date)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, cached: bool = True) -> "GoldModel":
        """Model over the driver's tables. The lazy plans (file listing,
        schema, analysis) are reused per session and directory; no data is
        cached. ``cached=False`` re-reads the folder listings."""
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if cached and key in _MODELS:
            return _MODELS[key]
        model = cls(
            spark=spark,
            fact=testdata.orders_fact(spark, sf_dir),
            products=testdata.products(spark, sf_dir),
            customers=testdata.customers(spark, sf_dir),
            suppliers=testdata.suppliers(spark, sf_dir),
            _dim_date=dim_date_covering(testdata.order_days(spark, sf_dir)),
            parts=(testdata.order_lines(spark, sf_dir), testdata.order_heads(spark, sf_dir)),
        )
        if cached:
            _MODELS[key] = model
        return model

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "GoldModel":
        root = root.rstrip("/")
        return cls(
            spark=spark,
            fact=spark.read.parquet(f"{root}/orders_fact"),
            products=spark.read.parquet(f"{root}/products"),
            customers=spark.read.parquet(f"{root}/customers"),
            suppliers=spark.read.parquet(f"{root}/suppliers"),
            _dim_date=_read_optional(spark, f"{root}/dim_date"),
        )

    @classmethod
    def from_gold(cls, spark: SparkSession, root: str, regions: DataFrame | None = None) -> "GoldModel":
        """The gold layer that the jobs write: of every dimension the snapshot
        that the run log points to (earlier snapshots aren't added up), and the
        fact. ``regions`` (Country, Region) places customers; without it Region
        is NULL, as Segment is where the layer has none."""
        from .jobs import medallion
        dims = {t: medallion.read_dimension(spark, root, t) for t in ("products", "customers", "suppliers")}
        missing = [t for t, d in dims.items() if d is None]
        if missing:
            raise ValueError(f"no gold snapshot of {', '.join(missing)} under {root}")
        customers, none = dims["customers"], F.lit(None).cast("string")
        if "Region" not in customers.columns:
            customers = customers.withColumn("Region", none) if regions is None else customers.join(regions.select("Country", "Region"), "Country", "left")
        if "Segment" not in customers.columns:
            customers = customers.withColumn("Segment", none)
        gold = f"{root.rstrip('/')}/gold"
        return cls(spark, medallion.read_fact(spark, root), dims["products"], customers, dims["suppliers"],
                   _dim_date=_read_optional(spark, f"{gold}/dim_date"))

    def write(self, root: str, mode: str = "overwrite") -> None:
        """Materialise the model as the gold layer (fact partitioned by year)."""
        root = root.rstrip("/")
        # Range-partition on (year, order): balanced tasks even when one year
        # holds a third of the rows, and each task writes into few year folders.
        (self.fact.withColumn("order_year", F.year("LastEditedWhen"))
         .repartitionByRange("order_year", "OrderID")
         .write.mode(mode).partitionBy("order_year").parquet(f"{root}/orders_fact"))
        self.products.write.mode(mode).parquet(f"{root}/products")
        self.customers.write.mode(mode).parquet(f"{root}/customers")
        self.suppliers.write.mode(mode).parquet(f"{root}/suppliers")
        self.dim_date.write.mode(mode).parquet(f"{root}/dim_date")


_MODELS: dict[tuple[str, str], GoldModel] = {}


def _read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
