"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

U64 = np.uint64
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``. Only a
    local session (tests) may leave it unset: it then gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder once and go on from the written table:
    cuts the lineage, so a lost executor repeats no finished work."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).resolve().parent.parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='llm-ship-')}/{package.name}", "zip", package.parent, package.name))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def is_fold(column: str, n: int, fold: int) -> Column:
    return F.coalesce(crc_mod(column, n) == fold, F.lit(False))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: T.StructType, rows: int = 1024) -> DataFrame:
    """mapInArrow in batches of at most ``rows`` rows, where ``make()`` runs once per task and returns a function
    from a batch to the output columns (lists, numpy or Arrow arrays); its
    ``finish``, if it has one, gives further rows at the end."""
    names = schema.fieldNames()
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield record(fn(batch.slice(at, rows)), types)
        last = getattr(fn, "finish", lambda: None)()  # what is left after the last batch
        if last:
            yield record(last, types)

    def record(cols, types):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types.field(n).type) for n, c in zip(names, cols)], names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a batch; null becomes empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split cuts exactly there)."""
    return text.encode("utf-8").split()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64) over an unsigned array."""
    x = (x ^ (x >> U64(30))) * _C2
    x = (x ^ (x >> U64(27))) * _C3
    return x ^ (x >> U64(31))


def seed(n: int) -> np.uint64:
    return mix(np.array([n], dtype=U64) * _C1 + _C1)[0]


class Cache(dict):
    """Word -> value, computed on first use; emptied when it holds ``limit``
    words, so memory stays bounded whatever the vocabulary."""

    def __init__(self, fn: Callable, limit: int = 300_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value
