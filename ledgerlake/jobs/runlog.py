"""Append-only run log: ``(Schema, Table_name, Status, Created_at, version, source)``.

A load is a number per table. Every layer writes a load into a folder of its own
and then appends one entry here, which commits it: a folder without an entry
doesn't count and is written over by the next attempt. What a layer has yet to
take is the anti-join of two layers' entries.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("Schema", T.StringType()),
    T.StructField("Table_name", T.StringType()),
    T.StructField("Status", T.StringType()),
    T.StructField("Created_at", T.TimestampNTZType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("source", T.StringType()),
])

#: Entries after which a load is done: a skipped load is left out on purpose.
DONE = ("success", "skipped")


def append(spark: SparkSession, log_path: str, schema: str, table: str, status: str,
           created_at: dt.datetime, version: int | None = None, source: str | None = None) -> None:
    row = [(schema, table, status, created_at, version, source)]
    spark.createDataFrame(row, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log_path)


def read(spark: SparkSession, log_path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(log_path)
    except AnalysisException:  # no run yet
        return spark.createDataFrame([], LOG_SCHEMA)


def entries(spark: SparkSession, log_path: str, schema: str, table: str, statuses: Sequence[str] = ("success",)) -> DataFrame:
    log = read(spark, log_path)
    return log.where((F.col("Schema") == schema) & (F.col("Table_name") == table) & F.col("Status").isin(*statuses))


def current_version(spark: SparkSession, log_path: str, schema: str, table: str) -> int | None:
    """The last committed load of a table in a layer."""
    return entries(spark, log_path, schema, table).agg(F.max("version")).first()[0]  # one row


def committed(spark: SparkSession, log_path: str, schema: str, table: str) -> DataFrame:
    """Numbers of the committed loads, as column ``load``."""
    return entries(spark, log_path, schema, table).select(F.col("version").alias("load")).distinct()


def pending(spark: SparkSession, log_path: str, taken: tuple[str, str], giver: tuple[str, str]) -> list[tuple[int, dt.datetime]]:
    """Loads that the layer ``giver`` has committed and ``taken`` hasn't, in load
    order, with the time stamp of the load."""
    done = entries(spark, log_path, *taken, statuses=DONE).select("version")
    rows = (entries(spark, log_path, *giver).join(done, "version", "left_anti")
            .groupBy("version").agg(F.min("Created_at").alias("at")).orderBy("version"))
    return [(r["version"], r["at"]) for r in rows.collect()]  # one row per load that waits


def load_of(spark: SparkSession, log_path: str, schema: str, table: str, source: str) -> int | None:
    """The committed load that a source (a stream's batch) became."""
    return entries(spark, log_path, schema, table).where(F.col("source") == source).agg(F.min("version")).first()[0]
