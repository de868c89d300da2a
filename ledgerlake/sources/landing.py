"""Landing-file scan with quarantine of malformed rows.

``PERMISSIVE`` CSV parsing keeps a bad line in a corrupt-record column
(wrong type, extra column, missing trailing column). Landing timestamps
(``ValidFrom`` / ``ValidTo`` / ``LastEditedWhen``) are read as text and parsed
with ``try_to_timestamp`` and a 24-hour pattern; a stamp that does not parse
sends the row to quarantine too, instead of becoming a silent NULL (the
reference's 12-hour ``hh`` pattern rejected 13:00 and mapped 12:30 to 00:30).

Directories and globs are read as one distributed scan; each row keeps its
source file (``_metadata.file_path``), kept in bronze so replays are detected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LANDING_TIMESTAMP_FORMAT

CORRUPT = "corrupt_record"
SOURCE, CHANGED = "source_file", "source_changed"
QUARANTINE_SCHEMA = "raw_line string, Schema string, source_file string, record_creation_date timestamp_ntz"


def csv_read_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])


def csv_options() -> dict[str, str]:
    return {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def parse_landing(df: DataFrame, schema: T.StructType,
                  timestamp_cols: Sequence[str] = ("ValidFrom", "ValidTo"),
                  fmt: str = LANDING_TIMESTAMP_FORMAT, required: Sequence[str] = ()) -> DataFrame:
    """Add ``source_file`` and its change time; parse text stamps. Rows with an
    unparsable stamp or without a required column are bad rows too."""
    df = df.withColumns({SOURCE: F.col("_metadata.file_path"), CHANGED: F.col("_metadata.file_modification_time")})
    bad_stamp = None
    for c in required:
        bad_stamp = F.col(c).isNull() if bad_stamp is None else (bad_stamp | F.col(c).isNull())
    present = [c for c in timestamp_cols if c in df.columns]
    for c in present:
        parsed = F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("timestamp_ntz")
        bad = F.col(c).isNotNull() & parsed.isNull()
        bad_stamp = bad if bad_stamp is None else (bad_stamp | bad)
        df = df.withColumn(f"__ts_{c}", parsed)
    if bad_stamp is not None:
        data_cols = [f.name for f in schema.fields]
        raw = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in data_cols])
        df = df.withColumn(CORRUPT, F.when(F.col(CORRUPT).isNull() & bad_stamp, raw).otherwise(F.col(CORRUPT)))
        for c in present:
            df = df.withColumn(c, F.col(f"__ts_{c}")).drop(f"__ts_{c}")
    return df


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
             timestamp_cols: Sequence[str] = ("ValidFrom", "ValidTo"),
             fmt: str = LANDING_TIMESTAMP_FORMAT, required: Sequence[str] = ()) -> DataFrame:
    """Typed CSV scan; adds ``corrupt_record`` (NULL for good rows) and ``source_file``."""
    df = (spark.read.format("csv").options(**csv_options()).schema(csv_read_schema(schema))
          .load(path if isinstance(path, str) else list(path)))
    return parse_landing(df, schema, timestamp_cols, fmt, required)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows without the corrupt column, corrupt rows).

    Both sides reference data columns besides the corrupt column, which is
    what Spark requires of a corrupt-record query on a raw CSV scan.
    """
    clean = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull())
    return clean, bad


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Names and change times of the files under a path, without reading them."""
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return files.select(F.col("_metadata.file_path").alias(SOURCE), F.col("_metadata.file_modification_time").alias(CHANGED))


def quarantine_rows(bad: DataFrame, schema: str, now: dt.datetime) -> DataFrame:
    """Rows for the shared quarantine table: raw line + origin, one layout for
    all tables (the table's name is the partition they are written to)."""
    return bad.select(
        F.col(CORRUPT).alias("raw_line"), F.lit(schema).alias("Schema"),
        F.col(SOURCE).alias("source_file"),
        F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz").alias("record_creation_date"),
    )
