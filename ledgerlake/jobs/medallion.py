"""Bronze -> silver -> gold jobs for dimensions and for the order fact.

A load is a number per table: the new files of one ingest (or one batch of a
stream). It keeps its number and its time stamp through all layers, and each
layer takes, in load order, every load that the layer before has committed and
it hasn't (``runlog.pending``). So the gold rows follow from the loads alone,
however often a job is stopped, when it runs again and what its clock says.

Layout under ``root``::

    bronze/<table>/load=<n>/bad=<0|1>   parsed rows of a load, each with its source_file
    bronze/_files/<table>/load=<n>      the files of a load (replays, archive)
    quarantine/Table_name=<table>/load=<n>   bad rows of all tables in one layout
    silver/<table>/load=<n>             latest row per key of the load, with audit columns
    gold/<table>/v=<n>/bucket=<b>       the key buckets that load n changed
    gold/_buckets/<table>/v=<n>         per bucket the load that wrote it last
    gold/orders_fact/order_year=<y>/load=<n>
    gold/late_keys/load=<n>             surrogate keys found after their order lines were loaded
    gold/dim_date/                      whole years, extended when orders need more
    log/                                run log; its entries commit the folders above

One writer per table is assumed, as for the jobs of the layers themselves.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce
from operator import or_
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import pack_key, unpack_key
from ..operators import calendar, dq, scd
from ..operators.dedupe import latest_per_key
from ..operators.sizing import partitions, with_heads
from ..schemas import DIMENSIONS, LANDING, REQUIRED, parsed
from ..sources import landing
from . import contracts, runlog
from .stage import StageResult, checked_write, ntz, run_stage, stamp

BUCKETS = 16  # key buckets of a new dimension; a merge rewrites those that its load touches
NOTHING = StageResult("nothing")


def _paths(root: str) -> dict[str, str]:
    root = root.rstrip("/")
    return {k: f"{root}/{k}" for k in ("bronze", "silver", "gold", "quarantine", "log")}


def _committed(spark: SparkSession, root: str, layer: str, table: str, rows: DataFrame) -> DataFrame:
    """Rows of committed loads (the list of loads is one short row each; Spark sizes the join)."""
    return rows.join(runlog.committed(spark, _paths(root)["log"], layer, table), "load", "left_semi")


# ---------------------------------------------------------------- bronze

FILES = T.StructType([T.StructField(landing.SOURCE, T.StringType()), T.StructField(landing.CHANGED, T.TimestampType())])


def bronze_schema(table: str) -> T.StructType:
    ts = T.TimestampNTZType()
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in parsed(*LANDING[table])), T.StructField(landing.SOURCE, T.StringType()),
                         T.StructField(landing.CHANGED, T.TimestampType()), T.StructField("insert_dt", ts), T.StructField("record_creation_date", ts),
                         T.StructField(landing.CORRUPT, T.StringType()), T.StructField("bad", T.IntegerType())])


def read_bronze(spark: SparkSession, root: str, table: str, load: int | None = None) -> DataFrame:
    """Clean rows of one load, or of all committed ones (with their ``load``)."""
    base = f"{_paths(root)['bronze']}/{table}"
    schema = bronze_schema(table)
    if load is None:
        rows = _committed(spark, root, "bronze", table, spark.read.schema(schema.add("load", T.IntegerType())).parquet(base))
    else:
        rows = spark.read.schema(schema).parquet(f"{base}/load={load}")
    return rows.where(F.col("bad") == 0).drop("bad", landing.CORRUPT)


def read_quarantine(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Bad rows of the committed loads of a table."""
    path = f"{_paths(root)['quarantine']}/Table_name={table}"
    schema = landing.QUARANTINE_SCHEMA + ", load int"
    try:
        return _committed(spark, root, "bronze", table, spark.read.schema(schema).parquet(path))
    except AnalysisException:
        return spark.createDataFrame([], schema)


def loaded_files(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Files of the committed loads, whether they held a clean row or not."""
    try:
        rows = spark.read.schema(T.StructType([*FILES, T.StructField("load", T.IntegerType())])).parquet(f"{_paths(root)['bronze']}/_files/{table}")
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([*FILES, T.StructField("load", T.IntegerType())]))
    return _committed(spark, root, "bronze", table, rows)


def new_files(spark: SparkSession, root: str, table: str, landing_path: str | Sequence[str]) -> list[tuple]:
    """(file, change time) of the landing files that no committed load holds.
    Names only: the listing reads no file, a changed file is a new one."""
    files = landing.list_files(spark, landing_path)
    rows = files.join(loaded_files(spark, root, table), [landing.SOURCE, landing.CHANGED], "left_anti").orderBy(landing.SOURCE)
    return [tuple(r) for r in rows.collect()]


def ingest_bronze(spark: SparkSession, root: str, table: str, landing_path: str | Sequence[str], now: dt.datetime,
                  checks: Sequence[dq.Check] | None = None) -> StageResult:
    """New landing files -> parsed rows, bad ones marked -> quarantine -> commit.
    Files of committed loads are skipped, so a replay loads nothing twice; a load
    that failed or was cut off is written again from its start."""
    files = new_files(spark, root, table, landing_path)
    if not files:
        return NOTHING
    schema, stamps = LANDING[table]
    names = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(urlsplit(f).path)) for f, _ in files]
    scheme = urlsplit(files[0][0])
    prefix = f"{scheme.scheme}://{scheme.netloc}" if scheme.scheme else ""
    rows = landing.read_csv(spark, [prefix + n for n in names], schema, stamps, required=REQUIRED[table])
    return load_rows(spark, root, table, rows, now, spark.createDataFrame(files, FILES), checks=checks)


def load_rows(spark: SparkSession, root: str, table: str, rows: DataFrame, now: dt.datetime, files: DataFrame | None = None,
              checks: Sequence[dq.Check] | None = None, source: str | None = None) -> StageResult:
    """Make one load of parsed landing rows: one write of all of them, the
    quarantine and the list of files out of what was written, then the commit."""
    p = _paths(root)
    load = (runlog.current_version(spark, p["log"], "bronze", table) or 0) + 1
    out = stamp(rows, now, ("insert_dt", "record_creation_date")).withColumn("bad", F.col(landing.CORRUPT).isNotNull().cast("int"))
    out = out.select(*bronze_schema(table).fieldNames())

    def beside(written: DataFrame, metrics: dict) -> None:
        bad = written.where(F.col("bad") == 1)
        landing.quarantine_rows(bad, "bronze", now).write.mode("overwrite").parquet(f"{p['quarantine']}/Table_name={table}/load={load}")
        of = written.select(landing.SOURCE, landing.CHANGED).distinct() if files is None else files
        of.write.mode("overwrite").parquet(f"{p['bronze']}/_files/{table}/load={load}")

    return run_stage(out, contracts.bronze_checks(table) if checks is None else checks, f"{p['bronze']}/{table}/load={load}", p["log"], "bronze", table,
                     now, load, partition_by=("bad",), source=source, judged=F.col("bad") == 0, before_commit=beside)


def skip_load(spark: SparkSession, root: str, layer: str, table: str, load: int, now: dt.datetime) -> None:
    """Leave a load that can't pass a layer's checks out of that layer for good."""
    runlog.append(spark, _paths(root)["log"], layer, table, "skipped", now, load)


# ---------------------------------------------------------------- archive

def archive_loaded(spark: SparkSession, root: str, table: str, archive_path: str, now: dt.datetime) -> int:
    """Move the landing files of finished loads to ``<archive>/load=<n>/``, from
    the list that was committed with each load. A file that is already there or
    that someone took away is passed over, so the job may stop anywhere and run
    again. Only names pass through the driver, a load at a time."""
    p = _paths(root)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    moved = 0
    for load, _ in runlog.pending(spark, p["log"], ("archive", table), ("bronze", table)):
        folder = fs_path(f"{archive_path.rstrip('/')}/load={load}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        files = loaded_files(spark, root, table).where(F.col("load") == load)
        for name, changed in sorted((r[landing.SOURCE], r[landing.CHANGED]) for r in files.collect()):
            src = fs_path(spark.sparkContext._jvm.java.net.URI(name))
            # a file that was replaced since belongs to a later load
            if fs.exists(src) and fs.getFileStatus(src).getModificationTime() == round(changed.timestamp() * 1000):
                moved += bool(fs.rename(src, fs_path(folder, src.getName())))
        runlog.append(spark, p["log"], "archive", table, "success", now, load)
    return moved


# ---------------------------------------------------------------- silver

def _audit(rows: DataFrame, at: dt.datetime, high_date: dt.datetime) -> DataFrame:
    ts = ntz(at)
    return rows.withColumns({"effective_start_dt": ts, "effective_end_dt": ntz(high_date), "active_flg": F.lit(1),
                             "insert_dt": ts, "update_dt": ts, "record_creation_date": ts})


def read_silver(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of the committed silver loads, with their ``load``."""
    return _committed(spark, root, "silver", table, spark.read.parquet(f"{_paths(root)['silver']}/{table}"))


def _each_pending(spark, root, taken: tuple[str, str], giver: tuple[str, str], run) -> StageResult:
    """Run a layer's step for every waiting load in order, up to the first that fails."""
    result = NOTHING
    for load, at in runlog.pending(spark, _paths(root)["log"], taken, giver):
        result = run(load, at)
        if result.status != "success":
            break
    return result


def build_silver(spark: SparkSession, root: str, table: str, now: dt.datetime, high_date: dt.datetime = scd.HIGH_DATE,
                 checks: Sequence[dq.Check] | None = None) -> StageResult:
    """Every bronze load not in silver yet: its latest row per key, by the version
    start that the source states, stamped with the load's time."""
    p, key = _paths(root), DIMENSIONS[table]["key"]

    def one(load: int, at: dt.datetime) -> StageResult:
        rows = latest_per_key(read_bronze(spark, root, table, load), [key], ["record_creation_date", "ValidFrom"])
        out = _audit(rows.drop("ValidTo", landing.CHANGED), at, high_date)
        return run_stage(out, contracts.silver_checks(table, at) if checks is None else checks, f"{p['silver']}/{table}/load={load}",
                         p["log"], "silver", table, at, load)

    return _each_pending(spark, root, ("silver", table), ("bronze", table), one)


def build_silver_orders(spark: SparkSession, root: str, now: dt.datetime, high_date: dt.datetime = scd.HIGH_DATE,
                        checks: Sequence[dq.Check] | None = None) -> StageResult:
    """Order lines of the bronze loads not in silver yet, with the order date and
    the audit columns of the fact (no dedupe: the grain is the order line)."""
    p = _paths(root)

    def one(load: int, at: dt.datetime) -> StageResult:
        rows = read_bronze(spark, root, "orders", load).drop(landing.CHANGED).withColumn("LastEditedDate", F.to_date("LastEditedWhen"))
        return run_stage(_audit(rows, at, high_date), contracts.silver_checks("orders", at) if checks is None else checks,
                         f"{p['silver']}/orders/load={load}", p["log"], "silver", "orders", at, load)

    return _each_pending(spark, root, ("silver", "orders"), ("bronze", "orders"), one)


# ---------------------------------------------------------------- gold dimensions

def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("bucket")


def _bucket_map(spark: SparkSession, root: str, table: str, version: int) -> list[tuple[int, int, int]]:
    """(bucket, the load that wrote it, bucket count): one row per bucket."""
    rows = spark.read.parquet(f"{_paths(root)['gold']}/_buckets/{table}/v={version}")
    return sorted((r["bucket"], r["written"], r["buckets"]) for r in rows.collect())


def _dimension_schema(spark: SparkSession, root: str, table: str) -> T.StructType:
    spec = DIMENSIONS[table]
    types = {f.name: f.dataType for f in bronze_schema(table)}
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, types[c]) for c in (spec["key"], *spec["t2"], *spec["t1"])]))
    return scd.initial_load(empty, spec["key"], spec["t1"], spec["t2"], dt.datetime(1900, 1, 1)).schema


def _read_buckets(spark, root, table, held: list[tuple[int, int, int]]) -> DataFrame:
    schema, base = _dimension_schema(spark, root, table), f"{_paths(root)['gold']}/{table}"
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/v={v}/bucket={b}" for b, v, _ in held])


def read_dimension(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The current versions and the history of a dimension: of every key bucket
    the folder that the last committed merge points to."""
    v = runlog.current_version(spark, _paths(root)["log"], "gold", table)
    return None if v is None else _read_buckets(spark, root, table, _bucket_map(spark, root, table, v))


def merge_dimension(spark: SparkSession, root: str, table: str, now: dt.datetime, reactivate_inactive: bool = True,
                    checks: Sequence[dq.Check] | None = None, buckets: int = BUCKETS) -> StageResult:
    """Merge every silver load not in gold yet into the dimension (SCD1+2), in load
    order and with the load's time as version time. Only the key buckets that a
    load touches are read and written again (copy on write)."""
    p, spec = _paths(root), DIMENSIONS[table]
    key, t1, t2 = spec["key"], spec["t1"], spec["t2"]

    def one(load: int, at: dt.datetime) -> StageResult:
        updates = spark.read.parquet(f"{p['silver']}/{table}/load={load}").select(key, *t2, *t1)
        before = runlog.current_version(spark, p["log"], "gold", table)
        held = [] if before is None else _bucket_map(spark, root, table, before)
        n = held[0][2] if held else buckets
        touched = {r["bucket"] for r in updates.select(bucket_of(key, n)).distinct().collect()}  # at most n numbers
        target = _read_buckets(spark, root, table, [h for h in held if h[0] in touched])
        merged = scd.merge(target, updates, key, t1, t2, at, reactivate_inactive=reactivate_inactive)
        out = merged.withColumn("bucket", bucket_of(key, n)).repartition("bucket")

        def beside(written: DataFrame, metrics: dict) -> None:
            rows = [h for h in held if h[0] not in touched] + [(b, load, n) for b in sorted(touched)]  # an update leaves rows in its bucket
            spark.createDataFrame(rows, "bucket int, written int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{p['gold']}/_buckets/{table}/v={load}")

        return run_stage(out, contracts.dimension_checks(table) if checks is None else checks, f"{p['gold']}/{table}/v={load}", p["log"], "gold", table,
                         at, load, partition_by=("bucket",), before_commit=beside)

    return _each_pending(spark, root, ("gold", table), ("silver", table), one)


# ---------------------------------------------------------------- gold calendar and fact

def build_dim_date(spark: SparkSession, root: str, now: dt.datetime,
                   start: dt.date = calendar.DEFAULT_START, end: dt.date = calendar.DEFAULT_END) -> StageResult:
    """Write the calendar anew."""
    p = _paths(root)
    df = stamp(calendar.dim_date(spark, start, end, run_date=now.strftime("%Y%m%d")), now, ("insert_dt", "update_dt"))
    return run_stage(df, [dq.Check("unique", "DateKey"), dq.Check("not_null", "date")], f"{p['gold']}/dim_date", p["log"], "gold", "dim_date", now, 1)


def extend_dim_date(spark: SparkSession, root: str, low: dt.date | None, high: dt.date | None, now: dt.datetime) -> int:
    """Append the whole years that lie between these days and the calendar and
    that it doesn't hold; returns how many. A calendar is written if there is none."""
    if low is None:
        return 0
    path = f"{_paths(root)['gold']}/dim_date"
    try:
        lo, hi = spark.read.parquet(path).agg(F.min("year"), F.max("year")).first()
    except AnalysisException:
        lo = hi = None
    years = set(range(min(low.year, lo or low.year), max(high.year, hi or high.year) + 1)) - set(range(lo or 1, (hi or 0) + 1))
    if years:
        first, last = dt.date(min(years), 1, 1), dt.date(max(years), 12, 31)
        days = calendar.dim_date(spark, first, last, run_date=now.strftime("%Y%m%d")).where(F.col("year").isin(*sorted(years)))
        stamp(days, now, ("insert_dt", "update_dt")).coalesce(1).write.mode("append").parquet(path)
        runlog.append(spark, _paths(root)["log"], "gold", "dim_date", "success", now, 1)
    return len(years)


#: Active suppliers up to which they are sent to every task: some 40 MB there.
FEW_SUPPLIERS = 500_000


#: Dimension -> its natural key in an order line, and the surrogate key there.
FACT_KEYS = {"products": ("ProductID", "product_skey"), "customers": ("CustomerID", "customer_skey"), "suppliers": ("SupplierId", "supplier_skey")}


def _active_keys(dim: DataFrame, lines: DataFrame, key: str, skey: str) -> DataFrame:
    """(natural key, packed surrogate key) of the active versions. Whole numbers have
    one text on both sides, so that a key may be hashed again from the line's."""
    numbers = all(isinstance(df.schema[key].dataType, T.IntegralType) for df in (dim, lines))
    start = "effective_start_dt" if numbers and "effective_start_dt" in dim.columns else None
    return dim.where(F.col("active_flg") == 1).select(key, pack_key("skey", key, start).alias(skey))


def assemble_fact(orders: DataFrame, products: DataFrame, customers: DataFrame, suppliers: DataFrame,
                  dim_date: DataFrame, few: bool = False, sort_by: Sequence[str] = ("CustomerID",),
                  heads: DataFrame | None = None) -> DataFrame:
    """Attach the four surrogate keys by left joins on the *active* versions.

    Dimensions are joined by natural key and hashed, so the lines of a task pass by
    unsorted; between the joins a key is carried as its version's start, or as bytes
    where it isn't the hash of that (``pack_key``), and written out after the last.
    The suppliers, the least dimension, are broadcast if they are ``few``.
    ``dim_date`` has one row per day of its range - bounded - and is broadcast.
    A task's lines come out sorted by ``sort_by``: the keys of a customer's lines,
    which no codec shortens, then lie together and take room once in a file.

    ``heads`` (OrderID, CustomerID, LastEditedWhen) are given where the lines don't
    say these themselves: customers are then looked up once an order, and lines meet
    their heads after the products, which spares them one shuffle of three.
    """
    base = orders.drop("date_skey", *(skey for _, skey in FACT_KEYS.values()))
    dims = {"products": products, "customers": customers, "suppliers": suppliers}
    buyers = base if heads is None else heads.withColumn("LastEditedDate", F.to_date("LastEditedWhen"))
    prod, cust, supp = (_active_keys(dims[t], buyers if t == "customers" else base, *of) for t, of in FACT_KEYS.items())
    dates = dim_date.select(F.col("date").alias("LastEditedDate"), F.col("DateKey").alias("date_skey"))
    lines = base.join(prod.hint("shuffle_hash"), "ProductID", "left")
    if heads is None:
        lines = lines.join(cust.hint("shuffle_hash"), "CustomerID", "left")
    else:
        lines = with_heads(lines, buyers.join(cust.hint("shuffle_hash"), "CustomerID", "left"), partitions(orders, heads))
    return (lines.join(F.broadcast(supp) if few else supp.hint("shuffle_hash"), "SupplierId", "left")
            .join(F.broadcast(dates), "LastEditedDate", "left")
            .sortWithinPartitions(*sort_by)
            .withColumns({skey: unpack_key(skey, key) for key, skey in FACT_KEYS.values()}))


LATE_KEYS = T.StructType([T.StructField("Table_name", T.StringType()), T.StructField("key", T.LongType()), T.StructField("skey", T.StringType()),
                          T.StructField("filled", T.TimestampNTZType()), T.StructField("load", T.IntegerType())])


def _late_keys(spark: SparkSession, root: str) -> DataFrame | None:
    """Surrogate keys that committed fills found, one row per natural key; None before the first fill."""
    p = _paths(root)
    if runlog.current_version(spark, p["log"], "gold", "late_keys") is None:
        return None
    return _committed(spark, root, "gold", "late_keys", spark.read.schema(LATE_KEYS).parquet(f"{p['gold']}/late_keys"))


def _lacks(table: str):
    key, skey = FACT_KEYS[table]
    return F.col(skey).isNull() & F.col(key).isNotNull()


def read_fact(spark: SparkSession, root: str) -> DataFrame:
    """Order lines of the committed loads. A line that was loaded before its
    customer (or product, supplier) was known has the surrogate key that
    ``fill_late_keys`` found since, and its time as ``update_dt``. Only lines that
    lack a key meet the found keys, and only of dimensions in which some were found;
    the written lines stay as they are."""
    lines = _committed(spark, root, "gold", "orders_fact", spark.read.parquet(f"{_paths(root)['gold']}/orders_fact"))
    found = _late_keys(spark, root)
    if found is None:
        return lines
    filled = {r["Table_name"] for r in found.select("Table_name").distinct().collect()}  # a name per dimension
    lacking = reduce(or_, map(_lacks, FACT_KEYS))
    late = lines.where(lacking).withColumns({skey: pack_key(skey) for _, skey in FACT_KEYS.values()})
    for table, (key, skey) in FACT_KEYS.items():
        if table not in filled:
            continue
        of = found.where(F.col("Table_name") == table).select(F.col("key").alias(key), pack_key("skey").alias("_skey"), F.col("filled").alias("_filled"))
        late = late.join(of, key, "left").withColumns({skey: F.coalesce(skey, "_skey"), "update_dt": F.when(_lacks(table), F.greatest("update_dt", "_filled")).otherwise(
            F.col("update_dt"))}).drop("_skey", "_filled")
    late = late.withColumns({skey: unpack_key(skey) for _, skey in FACT_KEYS.values()})
    return lines.where(~lacking).unionByName(late.select(lines.columns))


def fill_late_keys(spark: SparkSession, root: str, now: dt.datetime) -> StageResult:
    """Find the surrogate keys that order lines still lack, in the dimensions as
    they are now, and commit them as a load of ``gold/late_keys``: one row per
    natural key, however many lines wait for it. The fact isn't written again. A
    key that no dimension holds yet goes on waiting; a run that finds none commits
    nothing, and one that stops before its log entry is written over by the next."""
    p = _paths(root)
    fact, parts = read_fact(spark, root), []
    for table, (key, skey) in FACT_KEYS.items():
        dim = read_dimension(spark, root, table)
        if dim is not None:
            waiting = fact.where(_lacks(table)).select(F.col(key).cast("long").alias("key")).distinct()
            active = dim.where(F.col("active_flg") == 1).groupBy(F.col(key).cast("long").alias("key")).agg(F.min("skey").alias("skey"))
            parts.append(active.join(waiting, "key", "left_semi").select(F.lit(table).alias("Table_name"), "key", "skey", ntz(now).alias("filled")))
    if not parts:
        return NOTHING
    load = (runlog.current_version(spark, p["log"], "gold", "late_keys") or 0) + 1
    path = f"{p['gold']}/late_keys/load={load}"
    rows = reduce(DataFrame.unionByName, parts)
    checks = [dq.Check("not_null", "key"), dq.Check("not_null", "skey"), dq.Check("unique", "skey")]
    result, metrics = checked_write(rows, checks, lambda df: df.write.mode("overwrite").parquet(path), lambda: spark.read.schema(rows.schema).parquet(path))
    if not metrics["rows"]:
        return NOTHING
    ok = all(success for *_, success in result)
    runlog.append(spark, p["log"], "gold", "late_keys", "success" if ok else "failure", now, load)
    return StageResult("success" if ok else "failure", result, load, metrics)


def build_fact(spark: SparkSession, root: str, orders: DataFrame | None = None, now: dt.datetime | None = None,
               checks: Sequence[dq.Check] | None = None) -> StageResult:
    """Gold fact of the silver order loads that aren't in it: surrogate keys from
    the current dimensions, the calendar extended to the orders' years, written
    once into the partitions of the load. A load whose keys a dimension doesn't
    hold yet fails the contract and waits for the next run. ``orders`` may narrow
    silver's rows. A dimension with two active versions of a key would multiply
    lines; the row count finds it."""
    p = _paths(root)
    silver = read_silver(spark, root, "orders") if orders is None else orders
    dims = {t: read_dimension(spark, root, t) for t in ("products", "customers", "suppliers")}
    absent = [t for t, d in dims.items() if d is None]
    if absent:
        raise ValueError(f"no gold snapshot of {', '.join(absent)}")
    few = dims["suppliers"].where(F.col("active_flg") == 1).count() <= FEW_SUPPLIERS

    def one(load: int, at: dt.datetime) -> StageResult:
        lines = silver.where(F.col("load") == load).withColumn("order_year", F.year("LastEditedWhen"))
        low, high, n = lines.agg(F.min("LastEditedDate"), F.max("LastEditedDate"), F.count("*")).first()  # one row, off the written load
        extend_dim_date(spark, root, low, high, now or at)
        days = spark.read.parquet(f"{p['gold']}/dim_date") if low else calendar.dim_date(spark, end=calendar.DEFAULT_START)
        # a customer's lines lie together in a year's file, where their keys and dates take no room
        fact = assemble_fact(lines, dims["products"], dims["customers"], dims["suppliers"], days, few, ("order_year", "load", "CustomerID", "OrderID"))
        fact = stamp(fact, at, ("insert_dt", "update_dt", "record_creation_date"))
        return run_stage(fact, [*(contracts.fact_checks() if checks is None else checks), dq.Check("row_count", None, {"value": n})],
                         f"{p['gold']}/orders_fact", p["log"], "gold", "orders_fact", at, load, partition_by=("order_year", "load"), dynamic=True)

    return _each_pending(spark, root, ("gold", "orders_fact"), ("silver", "orders"), one)
