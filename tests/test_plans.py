"""Plans: what is pruned, what isn't copied, and that building a query runs nothing."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.jobs.medallion import assemble_fact
from ledgerlake.functions.hashing import surrogate_key
from ledgerlake.model import GoldModel
from ledgerlake.operators.distinct import two_distinct_counts
from ledgerlake.operators.topk import top_k_with_ties
from ledgerlake.params import DEFAULT
from ledgerlake.plans import catalog, kpi, reports

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_calendar_prunes_year_folders(spark, scratch):
    GoldModel.from_testdata(spark, SF).write(scratch)
    m = GoldModel.from_parquet(spark, scratch)
    plan = _plan(reports.customer_report(m, DEFAULT))
    assert "dynamicpruning" in plan.lower()
    few = m.on_days("year = 1996")
    lines = few.fact_in_calendar()
    want = m.fact.where(F.year("LastEditedDate") == 1996).count()
    assert lines.count() == want > 0
    scan = [n for n in lines._jdf.queryExecution().executedPlan().collectLeaves().mkString("\n").split("\n") if "order_year" in n]
    assert scan and any("dynamicpruning" in n.lower() for n in scan)


@pytest.mark.parametrize("name", ["customer_report", "product_report", "product_metrics"])
def test_distinct_counts_without_expand(spark, name):
    assert "Expand" not in _plan(catalog.queries()[name](spark, SF))


def test_lines_joined_by_order_move_once(spark):
    """Over a sort-merge join on the order, the first level adds no exchange of lines."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = GoldModel.from_testdata(spark, SF, cached=False)
        df = two_distinct_counts(m.fact, ["ProductID"], ("OrderID", "o"), ("CustomerID", "c"), {"q": ("sum", F.col("Quantity"))})
        # lines and orders for the join, then by (product, customer), then by product
        assert _plan(df).count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_two_distinct_counts_equal_sql(spark):
    rows = [(k, a, b, v) for k in (1, 2, None) for a, b, v in [(1, 1, 5), (1, 2, 6), (1, 1, 7), (2, 1, None), (None, 3, 1), (3, None, 2), (None, None, 9), (1, 2, 6)]]
    df = spark.createDataFrame(rows, "k int, a int, b int, v int")
    got = two_distinct_counts(df, ["k"], ("a", "na"), ("b", "nb"), {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))})
    want = df.groupBy("k").agg(F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("values", [[], [None], [None, None, 3], [5, 5, 5, 4, 4, 1], [9, 8, 8, 8, 8, 8, 2, None], list(range(30)), [1] * 40])
def test_top_k_equals_rank(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(3)
    ranks = {i: 1 + sum(x is not None and (v is None or x > v) for x in values) for i, v in enumerate(values)}
    got = {r.i: r.rk for r in top_k_with_ties(df, "v", 3, "rk").collect()}
    assert got == {i: r for i, r in ranks.items() if r <= 3}


def test_building_a_query_runs_nothing(spark):
    """Only the RFM scores and the layer jobs work while they are built."""
    sc = spark.sparkContext
    for name, query in catalog.queries().items():
        if name.startswith(("rfm_", "etl_", "stream_")):
            continue
        query(spark, SF)  # file listings and schemas of the first read
        sc.setJobGroup(f"build-{name}", name)
        query(spark, SF)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        sc.setJobGroup("none", "none")
        # reading a Parquet schema is one short job
        assert len(jobs) <= 4, (name, len(jobs))


def test_tasks_are_as_many_as_the_tables_ask_for(spark, monkeypatch):
    """Shuffles under hash tables and sorts of order lines have partitions by input size, not by the session."""
    from ledgerlake.operators import sizing
    monkeypatch.setattr(sizing, "PARTITION_BYTES", 10_000)
    m = GoldModel.from_testdata(spark, SF, cached=False)
    for query in (reports.customer_report, reports.product_metrics):
        plan = _plan(query(m, DEFAULT))
        sizes = [int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan)]
        assert len(sizes) == 4 and min(sizes) > 10 and "SortMergeJoin" not in plan


def test_orders_by_brand_are_hashed_in_tasks_by_size(spark, monkeypatch):
    """No distinct count hashes orders in the session's number of tasks: only rows per brand are left for those."""
    from ledgerlake.operators import sizing
    monkeypatch.setattr(sizing, "PARTITION_BYTES", 10_000)
    m = GoldModel.from_testdata(spark, SF, cached=False)
    for query in (lambda m, p: kpi.kpi_base(m, p, "brand"), kpi.kpi_yoy_pct_by_brand, kpi.orders_aov_by_month_top_brands):
        plan = _plan(query(m, DEFAULT))
        shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        free = [line for line in shuffles if "REPARTITION_BY_NUM" not in line]
        assert len(shuffles) - len(free) >= 5 and not any("OrderID" in line or "ProductID" in line for line in free)
        assert min(int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan)) > 10


def test_products_of_a_segment_are_hashed_in_tasks_by_size(spark, monkeypatch):
    """The distinct products per segment are not hashed in the session's number of tasks."""
    from ledgerlake.operators import sizing
    monkeypatch.setattr(sizing, "PARTITION_BYTES", 10_000)
    m = GoldModel.from_testdata(spark, SF, cached=False)
    plan = _plan(reports.revenue_by_product_segment(m, DEFAULT))
    joins = [line for line in plan.split("\n") if re.search(r"Exchange hashpartitioning\(ProductID#\d+L?, \d+\)", line)]
    assert len(joins) == 2 and all("REPARTITION_BY_NUM" in line for line in joins)
    assert min(int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan)) > 10


def test_distinct_counts_with_repeated_and_missing_firsts(spark):
    rows = [(1, None, i % 3, 1) for i in range(50)] + [(1, 7, 2, 1)] * 30 + [(1, 7, None, 1), (2, None, None, 1), (None, 5, 1, None)]
    df = spark.createDataFrame(rows, "k int, a int, b int, v int")
    got = two_distinct_counts(df, ["k"], ("a", "na"), ("b", "nb"), {"s": ("sum", F.col("v"))})
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, 3, 81), (2, 0, 0, 1), (None, 1, 1, None)]


@pytest.mark.parametrize("name", ["kpi_base_by_brand", "kpi_yoy_pct_by_brand", "orders_aov_by_month_top_brands"])
def test_lines_pass_by_hashed_products_unsorted(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalog.queries()[name](spark, SF))
        joins = [line for line in plan.split("\n") if "SortMergeJoin" in line]
        assert "ShuffledHashJoin" in plan and not any("ProductID" in line or "OrderID" in line for line in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lines_meet_dimensions_unsorted_with_packed_keys(spark):
    """The joins of the fact sort no lines, and shuffles carry keys as bytes."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["orders_fact"](spark, SF)
        plan = _plan(df)
        assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 3  # orders, products, customers
        fields = {a.name() + a.dataType().typeName() for n in _exchanges(df) for a in n}
        assert "product_skeybinary" in fields and not any(f.endswith("_skeystring") for f in fields)
        assert df.where("product_skey IS NULL OR length(product_skey) <> 64").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _exchanges(df):
    """Output columns of every exchange of a plan that hasn't run."""
    nodes, found = [df._jdf.queryExecution().executedPlan().initialPlan()], []
    while nodes:
        n = nodes.pop()
        if n.nodeName() == "Exchange":
            found.append([n.output().apply(i) for i in range(n.output().size())])
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    return found


def test_lines_cross_two_shuffles_and_come_out_by_customer(spark, scratch):
    """Customers are looked up once an order; a customer's lines lie together in a file."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["orders_fact"](spark, SF)
        of_lines = [e for e in _exchanges(df) if "LineNumber" in {a.name() for a in e}]
        assert len(of_lines) == 2
        df.write.parquet(f"{scratch}/fact")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    files = glob.glob(f"{scratch}/fact/*.parquet")
    assert files
    for f in files:
        ids = [r[0] or 0 for r in spark.read.parquet(f).select("CustomerID").collect()]
        assert ids == sorted(ids)


def test_keys_are_the_dimensions_own_with_heads_or_without(spark):
    """Null and repeated keys, closed versions, keys that hash nothing: heads apart give the rows of heads joined before."""
    lines = spark.createDataFrame([(1, 1, 10, 7), (1, 2, 11, 7), (2, 1, 10, None), (2, 1, 10, None), (3, 1, None, 8), (4, 1, 12, 9), (None, 1, 10, 7), (9, 1, 10, 7)],
                                  "OrderID long, LineNumber int, ProductID long, SupplierId long")
    heads = spark.createDataFrame([(1, 100, "2024-03-01"), (2, None, "2024-03-02"), (3, 101, None), (3, 102, "2024-03-03"), (4, 103, "2024-03-04"), (None, 100, "2024-03-01"), (5, 100, "2024-03-01")],
                                  "OrderID long, CustomerID long, day string").select("OrderID", "CustomerID", F.col("day").cast("timestamp_ntz").alias("LastEditedWhen"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    own = lambda ids, key, odd: spark.createDataFrame(ids, f"{key} long, active_flg int").withColumn("effective_start_dt", start).withColumn(
        "skey", F.when(F.col(key) % 2 == odd, F.concat(F.lit("key of "), F.col(key).cast("string"))).otherwise(surrogate_key(key, "effective_start_dt")))
    products, suppliers = own([(10, 1), (11, 1), (12, 0), (None, 1)], "ProductID", 1), own([(7, 1), (8, 1)], "SupplierId", 0)
    customers = own([(100, 1), (101, 1), (101, 0), (102, 1), (103, 0)], "CustomerID", 1)
    days = spark.sql("SELECT explode(sequence(DATE'2024-03-01', DATE'2024-03-03')) AS date").withColumn("DateKey", F.date_format("date", "yyyyMMdd"))
    joined = lines.join(heads, "OrderID").withColumn("LastEditedDate", F.to_date("LastEditedWhen"))
    columns = ["OrderID", "LineNumber", "ProductID", "SupplierId", "CustomerID", "LastEditedWhen", "LastEditedDate", "date_skey", "product_skey", "customer_skey", "supplier_skey"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    apart = rows(assemble_fact(lines, products, customers, suppliers, days, heads=heads))
    assert apart == rows(assemble_fact(joined, products, customers, suppliers, days)) == rows(
        assemble_fact(joined, products.drop("effective_start_dt"), customers.drop("effective_start_dt"), suppliers.drop("effective_start_dt"), days))
    want = joined
    for dim, key, skey in ((products, "ProductID", "product_skey"), (customers, "CustomerID", "customer_skey"), (suppliers, "SupplierId", "supplier_skey")):
        want = want.join(dim.where("active_flg = 1").select(key, F.col("skey").alias(skey)), key, "left")
    want = want.join(days.select(F.col("date").alias("LastEditedDate"), F.col("DateKey").alias("date_skey")), "LastEditedDate", "left")
    assert len(apart) == 7 and apart == rows(want)
    assert {r[8] for r in apart} >= {"key of 11", None} and {r[9] for r in apart} >= {"key of 101", None}
