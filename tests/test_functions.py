"""T-SQL style date arithmetic and exact money helpers."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlake.functions.dates import add_months_ts, day_diff, month_diff
from ledgerlake.functions.hashing import change_hash, pack_key, surrogate_key, unpack_key
from ledgerlake.functions.money import exact_avg, half_up_div, unit_price_from_extended


def test_month_and_day_diffs(spark):
    rows = [(dt.datetime(2020, 1, 31), dt.datetime(2020, 2, 29)),   # not a whole month
            (dt.datetime(2020, 1, 15), dt.datetime(2020, 2, 15)),
            (dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 2, 1)),  # 2 hours: 0 whole days
            (dt.datetime(2020, 3, 1), dt.datetime(2020, 3, 1))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [tuple(r) for r in df.select(month_diff("a", "b"), day_diff("a", "b")).collect()]
    assert got == [(0, 29), (1, 31), (0, 0), (0, 0)]


def test_dateadd_month_clamps(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 12, 31),)], "t timestamp_ntz")
    assert df.select(add_months_ts("t", -3)).first()[0] == dt.datetime(2018, 9, 30)


def test_half_up_division_is_exact(spark):
    df = spark.createDataFrame([(5, 2), (-5, 2), (7, 3), (1, 0)], "a long, b long")
    assert [r[0] for r in df.select(half_up_div("a", "b")).collect()] == [3, -3, 2, None]


def test_exact_avg(spark):
    df = spark.createDataFrame([(Decimal("1.00"),), (Decimal("2.00"),), (Decimal("2.00"),)], "p decimal(12,2)")
    g = df.agg(F.sum((F.col("p") * 100).cast("decimal(38,0)")).alias("u"), F.count("p").alias("n"))
    r = g.select(exact_avg("u", "n", 2, 2).alias("a2"), exact_avg("u", "n", 2, 6).alias("a6")).first()
    assert r.a2 == Decimal("1.67") and r.a6 == Decimal("1.666667")


def test_unit_price_cents(spark):
    df = spark.createDataFrame([(3.0, 10.0), (3.0, 10.01), (2.0, 0.01)], "q double, e double")
    got = [r[0] for r in df.select(unit_price_from_extended("e", "q")).collect()]
    assert got == [Decimal("3.33"), Decimal("3.34"), Decimal("0.01")]


def test_change_hash_is_null_safe(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    h = [r[0] for r in df.select(change_hash(["x", "y"])).collect()]
    assert h[0] != h[1]


def test_publish_views_read_back(spark):
    from ledgerlake.model import GoldModel
    from ledgerlake.plans.catalog import publish_views
    m = GoldModel.from_testdata(spark, "/root/testdata/sf0.001")
    names = publish_views(spark, m, ["revenue_by_month", "top_5_brands"], prefix="gold_")
    assert names == ["gold_revenue_by_month", "gold_top_5_brands"]
    assert spark.table("gold_top_5_brands").count() >= 5


def test_packed_keys_read_back(spark):
    """Half as long for a digest, and every other text comes back as it was."""
    keys = ["0123456789abcdef" * 4, "0123456789ABCDEF" * 4, "0123456789abcdef" * 4 + "\n", "x" * 32, "", "\u00e9\u4e2d", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", pack_key("k").alias("b"))
    rows = df.select("k", F.octet_length("b").alias("n"), unpack_key("b").alias("back")).collect()
    assert [r["back"] for r in rows] == keys and rows[0]["n"] == 32


def test_a_key_that_hashes_its_version_travels_as_the_start(spark):
    """Any other key, also one of another number or another start, comes back as it was."""
    at, other = dt.datetime(2024, 3, 1, 13, 30), dt.datetime(2024, 3, 2)
    rows = [(1, at, 1, at), (2, at, 1, at), (3, at, 3, other), (4, None, 4, at), (5, None, 5, None), (None, at, 6, at), (-7, at, -7, at)]
    df = spark.createDataFrame(rows, "k int, start timestamp_ntz, of long, hashed timestamp_ntz").withColumn("skey", surrogate_key("of", "hashed"))
    df = df.unionByName(spark.createDataFrame([(8, at, 8, at, "S-8"), (9, at, 9, at, None), (10, at, 10, at, "")], df.schema))
    got = df.withColumn("b", pack_key("skey", "k", "start")).select("k", "skey", F.octet_length("b").alias("n"), unpack_key("b", "k").alias("back")).collect()
    assert [r["back"] for r in got] == [r["skey"] for r in got]
    assert [r["n"] for r in got] == [19, 32, 32, 32, 32, 32, 19, 36, None, 33]
