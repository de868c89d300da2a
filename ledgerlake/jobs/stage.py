"""Write -> judge -> commit, the outcome handling shared by every layer.

The checks of a stage are read off its write: row checks are observed while the
rows pass to the staging folder, uniqueness is counted on the written columns.
The input is evaluated once. The folder becomes part of the layer with the run
log's entry, which is appended only if every check passed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import dq
from . import runlog


@dataclass
class StageResult:
    status: str  # success | failure | nothing
    dq: list[tuple] | None = None  # as dq.RESULT_SCHEMA
    version: int | None = None
    metrics: dict | None = None


def ntz(now: dt.datetime) -> Column:
    return F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def stamp(df: DataFrame, now: dt.datetime, cols: Sequence[str] = ("record_creation_date",)) -> DataFrame:
    """Audit timestamps: one literal per run (overwrites existing columns)."""
    return df.withColumns({c: ntz(now) for c in cols})


#: Spark's own setting; without it shuffle files stay until the driver's garbage collector finds their plan unused.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files when they end. A write's rows are in
    its folder then, so the disk holds the layers and the shuffles of one write."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def checked_write(df: DataFrame, checks: Sequence[dq.Check], write: Callable[[DataFrame], None], written: Callable[[], DataFrame],
                  judged: Column | None = None) -> tuple[list[tuple], dict]:
    """Write ``df`` once and judge it: (results as of ``dq.run_checks``, observed
    metrics). ``judged`` restricts the checks to the rows that it holds for."""
    observation = Observation()
    with freed(df.sparkSession):
        write(df.observe(observation, *dq.row_metrics(checks, df.columns, judged)))
        metrics = observation.get
        return dq.from_metrics(df, checks, metrics, written, judged), metrics


def run_stage(df: DataFrame, checks: Sequence[dq.Check], out_path: str, log_path: str, schema: str, table: str, now: dt.datetime,
              version: int, partition_by: Sequence[str] = (), source: str | None = None, judged: Column | None = None,
              dynamic: bool = False, before_commit: Callable[[DataFrame, dict], None] | None = None) -> StageResult:
    """Write a load's folder (or, with ``dynamic``, its own partitions of the table),
    then log its success, which commits it, or its failure."""
    spark = df.sparkSession

    def write(rows: DataFrame) -> None:
        # zstd takes half of a key's hex digits; version 2 writes numbers and lengths as differences
        w = rows.write.mode("overwrite").options(**{"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"})
        if dynamic:
            w = w.option("partitionOverwriteMode", "dynamic")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(out_path)

    def written() -> DataFrame:
        rows = spark.read.schema(df.schema).parquet(out_path)
        return rows.where(F.col("load") == version) if dynamic else rows

    result, metrics = checked_write(df, checks, write, written, judged)
    ok = all(success for *_, success in result)
    if ok and before_commit is not None:
        before_commit(written(), metrics)
    runlog.append(spark, log_path, schema, table, "success" if ok else "failure", now, version, source)
    return StageResult("success" if ok else "failure", result, version, metrics)
