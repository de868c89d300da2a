"""Catalog tables: what joins and aggregates of bucketed tables don't move."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlake.jobs import tables
from ledgerlake.model import GoldModel
from ledgerlake.params import DEFAULT
from ledgerlake.plans import reports, rfm

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gold(spark, tmp_path_factory):
    database = "gold_" + uuid.uuid4().hex
    tables.publish(GoldModel.from_testdata(spark, SF), database, str(tmp_path_factory.mktemp("gold")), buckets=8)
    return database, tables.open_model(spark, database)


@pytest.fixture()
def sorted_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lines_join_customers_without_exchange(spark, gold, sorted_joins):
    m = gold[1]
    df = m.fact.join(m.active_customers(), "CustomerID").groupBy("CustomerID").agg(F.count("*").alias("n"))
    assert "Exchange" not in _plan(df)
    raw = GoldModel.from_testdata(spark, SF)
    want = raw.fact.join(raw.active_customers(), "CustomerID").groupBy("CustomerID").agg(F.count("*").alias("n"))
    assert "Exchange" in _plan(want)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_customer_activity_without_exchange(spark, gold):
    assert "Exchange" not in _plan(rfm.customer_activity(gold[1], DEFAULT))


def test_distinct_orders_by_customer_without_exchange(gold):
    assert "Exchange" not in _plan(gold[1].fact.select("CustomerID", "OrderID").distinct().groupBy("CustomerID").count())


def test_years_are_pruned(gold):
    plan = _plan(gold[1].fact.where("order_year = 1996"))
    assert "order_year" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "dynamicpruning" in _plan(reports.customer_report(gold[1], DEFAULT)).lower()


def test_the_catalog_states_the_layout(spark, gold):
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {gold[0]}.orders_fact").collect()}
    assert rows["Num Buckets"] == "8" and rows["Bucket Columns"] == "[`CustomerID`]" and "# Partition Information" in rows


def test_equal_keys_share_a_bucket_and_nothing_is_lost(spark, gold, scratch):
    raw = GoldModel.from_testdata(spark, SF)
    hot = raw.fact.withColumn("CustomerID", F.when(F.col("OrderID") % 3 == 0, F.lit(7)).when(F.col("OrderID") % 3 == 1, F.col("CustomerID")))
    m = GoldModel(spark, hot, raw.products, raw.customers, raw.suppliers, raw.dim_date)
    database = "hot_" + uuid.uuid4().hex
    tables.publish(m, database, scratch, buckets=4)
    back = tables.open_model(spark, database)
    counts = lambda f: sorted(map(tuple, f.groupBy("CustomerID").count().collect()), key=str)
    assert counts(back.fact) == counts(hot)
    tables.publish(m, database, scratch, buckets=4)  # replaced, not added to
    assert counts(tables.open_model(spark, database).fact) == counts(hot)


def test_the_fact_is_written_by_as_many_tasks_as_its_size_asks_for(spark, scratch, monkeypatch):
    monkeypatch.setattr(tables, "partitions", lambda *inputs: 23)
    database = "sized_" + uuid.uuid4().hex
    tables.publish(GoldModel.from_testdata(spark, SF, cached=False), database, f"{scratch}/{database}")
    assert len({f.rsplit("/", 1)[1][:10] for f in spark.table(f"{database}.orders_fact").inputFiles()}) == 23


def test_an_empty_model(spark, scratch):
    raw = GoldModel.from_testdata(spark, SF)
    none = GoldModel(spark, raw.fact.limit(0), raw.products.limit(0), raw.customers.limit(0), raw.suppliers.limit(0), raw.dim_date)
    database = "none_" + uuid.uuid4().hex
    tables.publish(none, database, scratch)
    assert tables.open_model(spark, database).fact.count() == 0
