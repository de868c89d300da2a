"""Loads through the layers: nothing is lost or doubled, wherever a job stops."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.jobs import medallion, runlog, stage
from ledgerlake.streaming.ingest import start_dimension_stream
from tests.test_pipeline import ORDERS_HEADER, PRODUCTS_HEADER, SUPPLIERS_HEADER, _line, _write, _write_raw


class Crash(Exception):
    pass


T = [dt.datetime(2024, 1, day) for day in range(1, 10)]
LOADS = [
    [_line(1), _line(2), _line(3), "bad,row", ",Ann,Lee,555,556,a@x.io,1 Main,Town,ST,12345,Land,2020.01.01 13:00:00,2030.01.01 00:00:00"],
    [_line(2, phone="999"), _line(3, addr="9 Side"), _line(4)],
    [_line(3, addr="10 Side", phone="777"), _line(5)],
]


def _gold(spark, root):
    d = medallion.read_dimension(spark, root, "customers")
    return sorted(map(tuple, d.select("CustomerID", "Address", "PhoneNumber", "active_flg", "effective_start_dt", "effective_end_dt", "update_dt", "skey").collect()), key=str)


def _bad(spark, root):
    return sorted(r.raw_line for r in medallion.read_quarantine(spark, root, "customers").collect())


def _steps(spark, root, d, now):
    medallion.ingest_bronze(spark, root, "customers", d, now)
    later = now + dt.timedelta(hours=5)  # silver and gold run on clocks of their own
    medallion.build_silver(spark, root, "customers", later)
    medallion.merge_dimension(spark, root, "customers", later + dt.timedelta(minutes=1))


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    """The three loads, one after the other, without a fault."""
    base = str(tmp_path_factory.mktemp("clean"))
    root, d = f"{base}/lake", f"{base}/landing"
    for i, lines in enumerate(LOADS):
        _write(d, f"f{i}.csv", lines)
        _steps(spark, root, d, T[i])
    return _gold(spark, root), _bad(spark, root)


def test_rows_of_the_clean_run(clean):
    gold, bad = clean
    assert len(gold) == 7 and len(bad) == 2  # 3 has three versions; a broken line and one without a key
    assert sorted(r[4:6] for r in gold if r[0] == 3) == [(T[0], T[1]), (T[1], T[2]), (T[2], dt.datetime(2100, 12, 31))]


@pytest.mark.parametrize("at", ["write", "log"])
def test_a_crash_at_any_step_ends_in_the_same_tables(spark, scratch, monkeypatch, clean, at):
    """Every second write (or log entry) of the whole flow fails, so that each layer
    is hit; the flow is run again, days later, until nothing fails."""
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    target = (stage, "checked_write") if at == "write" else (runlog, "append")
    real, calls = getattr(*target), {"n": 0, "fail": 1}

    def failing(*a, **k):
        calls["n"] += 1
        if calls["n"] == calls["fail"]:
            calls["fail"] += 2
            if at == "write":
                real(*a, **k)  # the folder is there, its commit isn't
            raise Crash
        return real(*a, **k)

    monkeypatch.setattr(*target, failing)
    for i, lines in enumerate(LOADS):
        _write(d, f"f{i}.csv", lines)
        for attempt in range(12):
            try:
                if attempt == 0 or runlog.current_version(spark, f"{root}/log", "bronze", "customers") != i + 1:
                    medallion.ingest_bronze(spark, root, "customers", d, T[i])
                medallion.build_silver(spark, root, "customers", T[i] + dt.timedelta(days=attempt + 40))
                medallion.merge_dimension(spark, root, "customers", T[i] + dt.timedelta(days=attempt + 80))
                break
            except Crash:
                pass
    assert calls["fail"] > 5
    assert (_gold(spark, root), _bad(spark, root)) == clean


def test_gold_takes_every_load_that_waits(spark, scratch, clean):
    """Three loads reach bronze before silver and gold run once."""
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    for i, lines in enumerate(LOADS):
        _write(d, f"f{i}.csv", lines)
        medallion.ingest_bronze(spark, root, "customers", d, T[i])
    medallion.build_silver(spark, root, "customers", T[8])
    medallion.merge_dimension(spark, root, "customers", T[8])
    assert (_gold(spark, root), _bad(spark, root)) == clean
    assert medallion.merge_dimension(spark, root, "customers", T[8]).status == "nothing"


def test_a_merge_writes_the_buckets_it_touches(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    _write(d, "a.csv", [_line(i, first=f"N{i}") for i in range(1, 401)])
    _steps(spark, root, d, T[0])
    _write(d, "b.csv", [_line(7, first="N7", phone="1")])
    _steps(spark, root, d, T[1])

    def size(v):
        return sum(os.path.getsize(f) for f in glob.glob(f"{root}/gold/customers/v={v}/**/*.parquet", recursive=True))

    assert len(glob.glob(f"{root}/gold/customers/v=1/bucket=*")) == medallion.BUCKETS
    assert len(glob.glob(f"{root}/gold/customers/v=2/bucket=*")) == 1 and size(2) < size(1) / 8
    dim = medallion.read_dimension(spark, root, "customers")
    assert dim.count() == 400 and dim.where("PhoneNumber = '1'").count() == 1


def test_a_failed_load_waits_and_can_be_skipped(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    _write(d, "a.csv", [_line(1, email="no mail")])
    medallion.ingest_bronze(spark, root, "customers", d, T[0])
    res = medallion.build_silver(spark, root, "customers", T[0])
    assert res.status == "failure" and ("regex", "Email") in {(k, c) for k, c, _, _, bad, _ in res.dq if bad}
    _write(d, "b.csv", [_line(2)])
    medallion.ingest_bronze(spark, root, "customers", d, T[1])
    assert medallion.build_silver(spark, root, "customers", T[1]).status == "failure"  # loads keep their order
    medallion.skip_load(spark, root, "silver", "customers", 1, T[1])
    assert medallion.build_silver(spark, root, "customers", T[1]).status == "success"
    assert [r.CustomerID for r in medallion.read_silver(spark, root, "customers").collect()] == [2]


def test_contracts_run_unasked(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    _write(d, "a.csv", [_line(1), _line(1, phone="2")])
    res = medallion.ingest_bronze(spark, root, "customers", d, T[0])
    assert res.status == "failure" and ("unique", "CustomerID") in {(k, c) for k, c, _, _, bad, _ in res.dq if bad}
    assert spark.read.parquet(f"{root}/log").where("Status = 'failure'").count() == 1


def test_a_stage_evaluates_its_input_once(spark, scratch):
    """Every input row passes one counter, whatever the number of checks."""
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    from ledgerlake.operators.dq import Check
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "cast(id % 10 as int) AS v", "concat('a', id) AS s").mapInPandas(count, "id long, v int, s string")
    checks = [Check("unique", "id"), Check("not_null", "v"), Check("regex", "s", {"pattern": "^a"}), Check("between", "v", {"min": 0, "max": 9}),
              Check("greater_than", "v", {"value": -1}), Check("max_length", "s", {"size": 9}), Check("row_count", None, {"value": 1000}), Check("unique", "s")]
    res = stage.run_stage(df, checks, f"{scratch}/t/load=1", f"{scratch}/log", "bronze", "t", T[0], 1)
    assert res.status == "success" and seen.value == 1000 and res.metrics["rows"] == 1000
    bad = stage.run_stage(df.withColumn("v", F.lit(None).cast("int")), checks, f"{scratch}/t/load=2", f"{scratch}/log", "bronze", "t", T[0], 2)
    assert bad.status == "failure" and runlog.current_version(spark, f"{scratch}/log", "bronze", "t") == 1


def test_empty_input_through_a_stage(spark, scratch):
    from ledgerlake.operators.dq import Check
    df = spark.createDataFrame([], "id long")
    assert stage.run_stage(df, [Check("unique", "id"), Check("not_null", "id")], f"{scratch}/t/load=1", f"{scratch}/log", "bronze", "t", T[0], 1).status == "success"
    assert spark.read.parquet(f"{scratch}/t/load=1").count() == 0


def test_file_names_with_special_characters(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    _write(d, "a b[1]{x}.csv", [_line(1)])
    _write(d, "empty.csv", [])
    assert medallion.ingest_bronze(spark, root, "customers", d, T[0]).status == "success"
    assert medallion.ingest_bronze(spark, root, "customers", d, T[1]).status == "nothing"
    assert medallion.read_bronze(spark, root, "customers").count() == 1


# ---- archive

@pytest.mark.parametrize("stop", [1, 2, 3, 4])
def test_archive_may_stop_anywhere(spark, scratch, monkeypatch, stop):
    root, d, arch = (os.path.join(scratch, x) for x in ("lake", "landing", "archive"))
    _write(d, "a.csv", [_line(1)])
    _write(d, "b.csv", [_line(2)])
    medallion.ingest_bronze(spark, root, "customers", d, T[0])
    _write(d, "late.csv", [_line(3)])  # not loaded: stays
    real, calls = runlog.append, {"n": 0}
    if stop == 1:  # before the moves
        pass
    elif stop in (2, 3):  # one file was moved, then the job stopped
        os.makedirs(f"{arch}/load=1")
        os.rename(f"{d}/a.csv", f"{arch}/load=1/a.csv")
    else:  # after the moves, before the log entry
        def fail(*a, **k):
            calls["n"] += 1
            if calls["n"] == 1:
                raise Crash
            return real(*a, **k)
        monkeypatch.setattr(runlog, "append", fail)
        with pytest.raises(Crash):
            medallion.archive_loaded(spark, root, "customers", arch, T[1])
    for _ in range(2):
        medallion.archive_loaded(spark, root, "customers", arch, T[1])
    assert sorted(os.listdir(f"{arch}/load=1")) == ["a.csv", "b.csv"] or {"a.csv", "b.csv"} <= set(os.listdir(f"{arch}/load=1"))
    assert [f for f in os.listdir(d) if f.endswith(".csv") and not f.startswith(".")] == ["late.csv"]
    # a new file under an old name is a new load
    _write(d, "a.csv", [_line(9)])
    assert medallion.ingest_bronze(spark, root, "customers", d, T[2]).status == "success"
    assert sorted(r.CustomerID for r in medallion.read_bronze(spark, root, "customers").collect()) == [1, 2, 3, 9]


# ---- streams

def _drain(spark, root, d, ck, clock):
    start_dimension_stream(spark, root, "customers", d, ck, clock=clock).awaitTermination()


def test_a_new_checkpoint_is_a_new_stream(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    clock = iter(T)
    _write(d, "s1.csv", [_line(1), _line(2)])
    _drain(spark, root, d, f"{scratch}/ck1", lambda: next(clock))
    _write(d, "s2.csv", [_line(3)])
    _drain(spark, root, d, f"{scratch}/ck2", lambda: next(clock))  # batch 0 again, but of another stream
    dim = medallion.read_dimension(spark, root, "customers")
    assert sorted(r.CustomerID for r in dim.collect()) == [1, 2, 3]
    assert medallion.read_bronze(spark, root, "customers").count() == 3  # s1 counted once


def test_rows_without_a_key_leave_the_stream(spark, scratch):
    root, d = os.path.join(scratch, "lake"), os.path.join(scratch, "landing")
    clock = iter(T)
    _write(d, "s1.csv", [LOADS[0][4], _line(1)])
    _drain(spark, root, d, f"{scratch}/ck", lambda: next(clock))
    _write(d, "s2.csv", [_line(2)])
    _drain(spark, root, d, f"{scratch}/ck", lambda: next(clock))
    assert sorted(r.CustomerID for r in medallion.read_dimension(spark, root, "customers").collect()) == [1, 2]
    assert [r.raw_line.startswith(",Ann,Lee") for r in medallion.read_quarantine(spark, root, "customers").collect()] == [True]


# ---- calendar and fact

def _dimensions(spark, root, scratch, now):
    lz = {t: os.path.join(scratch, f"landing_{t}") for t in ("customers", "products", "suppliers", "orders")}
    _write(lz["customers"], "c.csv", [_line(1)])
    _write_raw(lz["suppliers"], "s.csv", SUPPLIERS_HEADER, ["7,Acme,555,a@acme.io,,"])
    _write_raw(lz["products"], "p.csv", PRODUCTS_HEADER, ["10,Bolt,red,BrandA,S,111,0.15,2.50,7,,"])
    for t in ("customers", "products", "suppliers"):
        medallion.ingest_bronze(spark, root, t, lz[t], now)
        medallion.build_silver(spark, root, t, now)
        medallion.merge_dimension(spark, root, t, now)
    return lz


def _orders(spark, root, lz, name, lines, now):
    _write_raw(lz["orders"], name, ORDERS_HEADER, lines)
    medallion.ingest_bronze(spark, root, "orders", lz["orders"], now)
    medallion.build_silver_orders(spark, root, now)
    return medallion.build_fact(spark, root, now=now)


def test_the_calendar_follows_the_orders(spark, scratch):
    root = os.path.join(scratch, "lake")
    lz = _dimensions(spark, root, scratch, T[0])
    assert _orders(spark, root, lz, "o1.csv", ["1,10,7,1,4,2.50,0.15,1,2024.02.01 10:00:00"], T[0]).status == "success"
    assert _orders(spark, root, lz, "o2.csv", ["2,10,7,1,4,2.50,0.15,1,2035.06.01 10:00:00", "3,10,7,1,4,2.50,0.15,1,1979.01.01 00:00:00"], T[1]).status == "success"
    fact = medallion.read_fact(spark, root)
    assert {r.OrderID: r.date_skey for r in fact.collect()} == {1: "20240201", 2: "20350601", 3: "19790101"}
    dates = spark.read.parquet(f"{root}/gold/dim_date")
    assert dates.count() == dates.select("date").distinct().count() == (dt.date(2035, 12, 31) - dt.date(1979, 1, 1)).days + 1


def test_a_load_with_unknown_keys_waits_for_its_dimension(spark, scratch):
    root = os.path.join(scratch, "lake")
    lz = _dimensions(spark, root, scratch, T[0])
    line = ["1,11,7,1,4,2.50,0.15,1,2024.02.01 10:00:00"]  # product 11 isn't known yet
    assert _orders(spark, root, lz, "o1.csv", line, T[0]).status == "failure"
    assert medallion.read_fact(spark, root).count() == 0
    _write_raw(lz["products"], "p2.csv", PRODUCTS_HEADER, ["11,Nut,blue,BrandB,M,112,0.15,1.25,7,,"])
    medallion.ingest_bronze(spark, root, "products", lz["products"], T[1])
    medallion.build_silver(spark, root, "products", T[1])
    medallion.merge_dimension(spark, root, "products", T[1])
    assert medallion.build_fact(spark, root, now=T[1]).status == "success"
    row = medallion.read_fact(spark, root).first()
    assert row.product_skey is not None and row.insert_dt == T[0]
    assert medallion.build_fact(spark, root, now=T[2]).status == "nothing" and medallion.read_fact(spark, root).count() == 1


def _customers(spark, root, lz, name, lines, now):
    _write(lz["customers"], name, lines)
    medallion.ingest_bronze(spark, root, "customers", lz["customers"], now)
    medallion.build_silver(spark, root, "customers", now)
    medallion.merge_dimension(spark, root, "customers", now)


def test_late_customers_get_their_keys(spark, scratch, monkeypatch):
    """Lines loaded before their customer: filled in later, once, with the fact's files left alone."""
    root = os.path.join(scratch, "lake")
    lz = _dimensions(spark, root, scratch, T[0])
    line = "{},10,7,{},4,2.50,0.15,1,2024.02.01 10:00:00".format
    assert _orders(spark, root, lz, "o1.csv", [line(1, 1), line(2, 2), line(3, 2), line(4, 9)], T[0]).status == "success"
    rows = lambda: {r.OrderID: (r.customer_skey, r.update_dt) for r in medallion.read_fact(spark, root).collect()}
    first, columns = rows(), medallion.read_fact(spark, root).columns
    assert [first[i][0] is None for i in (1, 2, 3, 4)] == [False, True, True, True]
    assert medallion.fill_late_keys(spark, root, T[1]).status == "nothing" and rows() == first  # none known yet: nothing is committed

    _customers(spark, root, lz, "c2.csv", [_line(2)], T[1])
    files = sorted(glob.glob(f"{root}/gold/orders_fact/**/*.parquet", recursive=True))
    with monkeypatch.context() as m:  # stopped between the write and its log entry
        m.setattr(runlog, "append", lambda *a, **k: (_ for _ in ()).throw(Crash))
        with pytest.raises(Crash):
            medallion.fill_late_keys(spark, root, T[2])
    assert rows() == first
    result = medallion.fill_late_keys(spark, root, T[3])
    assert result.status == "success" and result.metrics["rows"] == 1  # a key, not its two lines
    keys = {r.CustomerID: r.skey for r in medallion.read_dimension(spark, root, "customers").collect()}
    assert rows() == {1: first[1], 2: (keys[2], T[3]), 3: (keys[2], T[3]), 4: (None, T[0])}
    assert sorted(glob.glob(f"{root}/gold/orders_fact/**/*.parquet", recursive=True)) == files
    assert medallion.fill_late_keys(spark, root, T[4]).status == "nothing"

    # a new version of customer 2 changes no filled line; new lines take the new one; 9 comes in a second fill
    _customers(spark, root, lz, "c3.csv", [_line(2, addr="7 Other"), _line(9)], T[4])
    assert _orders(spark, root, lz, "o2.csv", [line(5, 2)], T[4]).status == "success"
    assert medallion.fill_late_keys(spark, root, T[5]).version == 2
    got, active = rows(), {r.CustomerID: r.skey for r in medallion.read_dimension(spark, root, "customers").where("active_flg = 1").collect()}
    assert got[2] == got[3] == (keys[2], T[3]) and got[4] == (active[9], T[5]) and got[5] == (active[2], T[4]) and active[2] != keys[2]
    assert medallion.read_fact(spark, root).columns == columns


def test_a_stage_leaves_no_shuffle_files(spark, scratch):
    """What a write and its checks shuffled is removed when they end, also while their plans are still held; the setting is put back."""
    files = lambda: {f.getName() for f in _list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, held = files(), spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(3, "id").groupBy("k").agg(F.max("id").alias("top"))
    setting = spark.conf.get(stage.CLEANUP, None)
    result = stage.run_stage(held, [stage.dq.Check("unique", "top")], f"{scratch}/out", f"{scratch}/log", "silver", "t", T[0], 1)
    left = files() - before
    assert result.status == "success" and result.metrics["rows"] == 7 and not left, left
    with pytest.raises(Crash), stage.freed(spark):
        raise Crash
    assert spark.conf.get(stage.CLEANUP, None) == setting


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_lines_meet_found_keys_of_their_dimension_only(spark, scratch):
    """Late customers: no line passes a join with products or suppliers, of which no key was found."""
    root = os.path.join(scratch, "lake")
    lz = _dimensions(spark, root, scratch, T[0])
    assert _orders(spark, root, lz, "o1.csv", ["1,10,7,2,4,2.50,0.15,1,2024.02.01 10:00:00"], T[0]).status == "success"
    _customers(spark, root, lz, "c2.csv", [_line(2)], T[1])
    assert medallion.fill_late_keys(spark, root, T[2]).status == "success"
    fact = medallion.read_fact(spark, root)
    assert fact._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 1
    row = fact.first()
    assert row.customer_skey and len(row.product_skey) == len(row.supplier_skey) == 64 and row.update_dt == T[2]
