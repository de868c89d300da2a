"""Landing quarantine, medallion flow and file-stream ingest."""

import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from ledgerlake.jobs import medallion, runlog
from ledgerlake.schemas import CUSTOMERS_CSV
from ledgerlake.sources import landing
from ledgerlake.streaming.ingest import start_dimension_stream

HEADER = ("CustomerID,CustomerFirstName,CustomerLastName,PhoneNumber,FaxNumber,Email,Address,City,State,"
          "Zip,Country,ValidFrom,ValidTo")


def _line(cid, first="Ann", addr="1 Main", phone="555", email="ann@x.io", vf="2020.01.01 13:00:00"):
    return f"{cid},{first},Lee,{phone},556,{email},{addr},Town,ST,12345,Land,{vf},2030.01.01 00:00:00"


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("\n".join([HEADER, *lines]) + "\n")


def test_csv_quarantine(spark, scratch):
    d = os.path.join(scratch, "landing")
    _write(d, "c1.csv", [
        _line(1),                                   # good, 13:00 valid with a 24-hour pattern
        _line(2, vf="2020.01.01 12:30:00"),         # good, stays 12:30
        "x3,Bob,Lee,555,556,b@x.io,1 Main,Town,ST,12345,Land,2020.01.01 00:00:00,2030.01.01 00:00:00",  # bad int
        _line(4) + ",extra",                        # extra column
        "5,Cy,Lee,555,556,c@x.io,1 Main,Town,ST,12345,Land",   # missing trailing columns
        _line(6, vf="2020-01-01T00:00:00"),         # unparsable stamp
    ])
    df = landing.read_csv(spark, d, CUSTOMERS_CSV)
    clean, bad = landing.split(df)
    good = {r.CustomerID: r.ValidFrom for r in clean.collect()}
    assert set(good) == {1, 2}
    assert good[1] == dt.datetime(2020, 1, 1, 13) and good[2] == dt.datetime(2020, 1, 1, 12, 30)
    assert bad.count() == 4
    q = landing.quarantine_rows(bad, "bronze", dt.datetime(2024, 1, 1))
    assert q.where(F.col("raw_line").isNull()).count() == 0


def test_medallion_flow_and_replay(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    t1, t2, t3 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)
    _write(d, "b1.csv", [_line(1), _line(2), _line(3)])
    assert medallion.ingest_bronze(spark, root, "customers", d, t1).status == "success"
    assert medallion.build_silver(spark, root, "customers", t1).status == "success"
    assert medallion.merge_dimension(spark, root, "customers", t1).status == "success"
    # second file: 2 changes phone (type 1), 3 changes address (type 2), 4 is new
    _write(d, "b2.csv", [_line(2, phone="999"), _line(3, addr="9 Side"), _line(4)])
    medallion.ingest_bronze(spark, root, "customers", d, t2)   # b1.csv is skipped by the file ledger
    assert spark.read.parquet(f"{root}/bronze/customers").count() == 6
    medallion.build_silver(spark, root, "customers", t2)       # only rows newer than the t1 high-water mark
    assert spark.read.parquet(f"{root}/silver/customers").count() == 6
    medallion.merge_dimension(spark, root, "customers", t2)
    dim = medallion.read_dimension(spark, root, "customers")
    assert runlog.current_version(spark, f"{root}/log", "gold", "customers") == 2
    rows = {(r.CustomerID, r.active_flg): r for r in dim.collect()}
    assert len(rows) == 5 and rows[(2, 1)].PhoneNumber == "999" and rows[(3, 0)].effective_end_dt == t2
    assert rows[(3, 1)].Address == "9 Side"
    # replay: nothing new lands, silver gets no rows, the merge is a no-op
    medallion.ingest_bronze(spark, root, "customers", d, t3)
    assert spark.read.parquet(f"{root}/bronze/customers").count() == 6
    # gold fact assembly against the snapshots and a calendar
    medallion.build_dim_date(spark, root, t3, dt.date(2023, 1, 1), dt.date(2024, 12, 31))
    assert spark.read.parquet(f"{root}/gold/dim_date").count() == 731


def test_stream_ingest_exactly_once(spark, scratch):
    root = os.path.join(scratch, "lake")
    d, ck, arch = (os.path.join(scratch, x) for x in ("landing", "ckpt", "archive"))
    clock = iter([dt.datetime(2024, 2, d) for d in range(1, 10)])
    _write(d, "s1.csv", [_line(1), _line(2), "bad,row"])
    q = start_dimension_stream(spark, root, "customers", d, ck, arch, clock=lambda: next(clock))
    q.awaitTermination()
    assert medallion.read_dimension(spark, root, "customers").count() == 2
    _write(d, "s2.csv", [_line(2, addr="7 New")])
    q = start_dimension_stream(spark, root, "customers", d, ck, arch, clock=lambda: next(clock))
    q.awaitTermination()
    dim = medallion.read_dimension(spark, root, "customers")
    assert dim.count() == 3 and dim.where("active_flg = 1").count() == 2
    # third run with no new file: no new batch, no new version
    v = runlog.current_version(spark, f"{root}/log", "gold", "customers")
    q = start_dimension_stream(spark, root, "customers", d, ck, arch, clock=lambda: next(clock))
    q.awaitTermination()
    assert runlog.current_version(spark, f"{root}/log", "gold", "customers") == v
    assert spark.read.parquet(f"{root}/quarantine").count() == 1


ORDERS_HEADER = "OrderID,ProductID,SupplierId,CustomerID,Quantity,UnitPrice,TaxRate,LastEditedBy,LastEditedWhen"
SUPPLIERS_HEADER = "SupplierId,SupplierName,PhoneNumber,Email,ValidFrom,ValidTo"
PRODUCTS_HEADER = "ProductID,ProductName,Color,Brand,Size,Barcode,TaxRate,UnitPrice,SupplierId,ValidFrom,ValidTo"


def _write_raw(folder, name, header, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("\n".join([header, *lines]) + "\n")


def test_orders_to_gold_fact(spark, scratch):
    root = os.path.join(scratch, "lake")
    t1 = dt.datetime(2024, 3, 1)
    lz = {t: os.path.join(scratch, f"landing_{t}") for t in ("customers", "products", "suppliers", "orders")}
    _write(lz["customers"], "c.csv", [_line(1), _line(2)])
    _write_raw(lz["suppliers"], "s.csv", SUPPLIERS_HEADER, ["7,Acme,555,a@acme.io,,"])
    _write_raw(lz["products"], "p.csv", PRODUCTS_HEADER,
               ["10,Bolt,red,BrandA,S,111,0.15,2.50,7,,", "11,Nut,blue,BrandB,M,112,0.15,1.25,7,,"])
    _write_raw(lz["orders"], "o.csv", ORDERS_HEADER, [
        "100,10,7,1,4,2.50,0.15,1,2024.02.01 10:00:00",
        "100,11,7,1,2,1.25,0.15,1,2024.02.01 10:00:00",
        "101,11,7,2,1,1.25,0.15,1,2024.02.03 23:30:00",
        "102,10,7,3,1,2.50,0.15,1,2024.02.04 09:00:00",   # customer 3 unknown -> NULL customer_skey
        "103,10,7,1,1,2.50,0.15,1,2024.13.04 09:00:00",   # bad stamp -> quarantine
    ])
    for t in ("customers", "products", "suppliers"):
        medallion.ingest_bronze(spark, root, t, lz[t], t1)
        medallion.build_silver(spark, root, t, t1)
        medallion.merge_dimension(spark, root, t, t1)
    medallion.build_dim_date(spark, root, t1, dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    medallion.ingest_bronze(spark, root, "orders", lz["orders"], t1)
    assert medallion.build_silver_orders(spark, root, t1).status == "success"
    silver = spark.read.parquet(f"{root}/silver/orders")
    assert silver.count() == 4
    res = medallion.build_fact(spark, root, silver, t1)
    assert res.status == "success"
    fact = spark.read.parquet(f"{root}/gold/orders_fact")
    rows = {(r.OrderID, r.ProductID): r for r in fact.collect()}
    assert len(rows) == 4 and {r.order_year for r in rows.values()} == {2024}
    assert rows[(101, 11)].date_skey == "20240203" and rows[(100, 10)].product_skey is not None
    assert rows[(102, 10)].customer_skey is None and rows[(100, 10)].supplier_skey is not None
    assert spark.read.parquet(f"{root}/quarantine").where("Table_name = 'orders'").count() == 1


def test_late_load_reaches_silver(spark, scratch):
    """A load stamped before a silver run but written after it is consumed by the next run."""
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    _write(d, "a.csv", [_line(1)])
    medallion.ingest_bronze(spark, root, "customers", d, dt.datetime(2024, 1, 1, 10))
    medallion.build_silver(spark, root, "customers", dt.datetime(2024, 1, 1, 12))
    _write(d, "b.csv", [_line(2)])
    medallion.ingest_bronze(spark, root, "customers", d, dt.datetime(2024, 1, 1, 11))
    medallion.build_silver(spark, root, "customers", dt.datetime(2024, 1, 1, 13))
    assert sorted(r.CustomerID for r in spark.read.parquet(f"{root}/silver/customers").select("CustomerID").collect()) == [1, 2]


def test_latest_version_in_one_load(spark, scratch):
    root, d, t = os.path.join(scratch, "lake"), os.path.join(scratch, "landing"), dt.datetime(2024, 1, 1)
    _write(d, "a.csv", [_line(1, addr="old", vf="2020.01.01 00:00:00"), _line(1, addr="new", vf="2021.01.01 00:00:00")])
    # the contract takes a key once per file, so it is left out here
    assert medallion.ingest_bronze(spark, root, "customers", d, t).status == "failure"
    medallion.ingest_bronze(spark, root, "customers", d, t, checks=[])
    medallion.build_silver(spark, root, "customers", t)
    assert [r.Address for r in spark.read.parquet(f"{root}/silver/customers").collect()] == ["new"]


def test_quarantine_once(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    _write(d, "bad.csv", ["bad,row"])
    for day in (1, 2, 3):
        medallion.ingest_bronze(spark, root, "customers", d, dt.datetime(2024, 1, day))
    assert spark.read.parquet(f"{root}/quarantine").count() == 1


def test_stream_replay_after_crash(spark, scratch, monkeypatch):
    """Bronze was written, then the merge crashed: the replay still merges."""
    from ledgerlake.schemas import DIMENSIONS
    from ledgerlake.streaming import ingest
    root, d, t = os.path.join(scratch, "lake"), os.path.join(scratch, "landing"), dt.datetime(2024, 1, 1)
    _write(d, "a.csv", [_line(1), _line(2)])
    batch = landing.read_csv(spark, d, DIMENSIONS["customers"]["csv"])
    with monkeypatch.context() as m:
        m.setattr(medallion, "merge_dimension", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.process_batch(spark, root, "customers", batch, 0, t)
    assert ingest.process_batch(spark, root, "customers", batch, 0, t) == "success"
    assert spark.read.parquet(f"{root}/bronze/customers").count() == 2
    assert medallion.read_dimension(spark, root, "customers").count() == 2
    assert ingest.process_batch(spark, root, "customers", batch, 0, t) == "skipped"


def test_fact_rerun_appends_nothing(spark, scratch):
    test_orders_to_gold_fact(spark, scratch)
    root = os.path.join(scratch, "lake")
    medallion.build_fact(spark, root, spark.read.parquet(f"{root}/silver/orders"), dt.datetime(2024, 3, 2))
    assert spark.read.parquet(f"{root}/gold/orders_fact").count() == 4
    medallion.build_silver_orders(spark, root, dt.datetime(2024, 3, 2))
    assert spark.read.parquet(f"{root}/silver/orders").count() == 4


def test_bronze_contract_accepts_a_good_file(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    _write(d, "a.csv", [_line(1)])
    assert medallion.ingest_bronze(spark, root, "customers", d, dt.datetime(2024, 1, 1)).status == "success"


def test_change_hash_has_no_collisions(spark):
    from ledgerlake.functions.hashing import change_hash
    rows = [("a~", "b"), ("a", "~b"), ("a", None), (None, "a"), ("1:a", ""), ("", "1:a"), ("-", None), (None, "-"), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "x string, y string").select(change_hash(["x", "y"]).alias("h"))
    assert df.distinct().count() == len(rows)


def test_analytics_on_the_jobs_gold_layer(spark, scratch):
    """A second product load closes a version and writes a second snapshot: revenue stays one revenue."""
    from ledgerlake.model import GoldModel
    from ledgerlake.params import DEFAULT
    from ledgerlake.plans import kpi, ranking
    test_orders_to_gold_fact(spark, scratch)
    root, t2 = os.path.join(scratch, "lake"), dt.datetime(2024, 4, 1)
    d = os.path.join(scratch, "landing_products")
    _write_raw(d, "p2.csv", PRODUCTS_HEADER, ["10,Bolt,red,BrandZ,S,111,0.15,2.50,7,,"])
    medallion.ingest_bronze(spark, root, "products", d, t2)
    medallion.build_silver(spark, root, "products", t2)
    medallion.merge_dimension(spark, root, "products", t2)
    regions = spark.createDataFrame([("Land", "Here")], "Country string, Region string")
    m = GoldModel.from_gold(spark, root, regions)
    assert m.products.count() == 3  # two active, one closed
    got = {r.Brand: r.total_revenue for r in ranking.top_brands(m, DEFAULT).collect()}
    assert got == {"BrandZ": 12.5, "BrandB": 3.75}
    assert {r.Region: r.orders for r in kpi.kpi_base(m, DEFAULT, by="region").collect()} == {"Here": 2, None: 1}
