"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids of a fixed width, documents one after another
with an end id after each. It is read in blocks that know nothing of
documents; each block is searched for the end id as one numpy comparison. A
document may begin in one block and end in a later one, so the blocks'
results are stitched by a prefix scan of (tokens, ends, last end): blocks
within groups of ``GROUP``, then the groups of a file. No file passes through
one task.

Defined results: null and empty texts have no tokens; tokens after a file's
last end id are a document with ``complete`` false; an empty file gives no
rows, as does an empty table; repeated rows are counted row by row."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, read, stash, texts
from .tokens import default_path, encoder

#: The first id that the tokenizer's vocabulary (49,408 ids) leaves free; 16-bit ids.
END, DTYPE = 49_408, "<u2"
BLOCK, GROUP = 1 << 18, 1024

BLOCKS = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType())])
WRITTEN = T.StructType([*BLOCKS, T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType()))])


def read_files(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = DTYPE) -> DataFrame:
    """Blocks of the flat token files under a path (each file is split by its own task)."""
    size = block * np.dtype(dtype).itemsize

    def make():
        def run(batch):
            file, number, data = [], [], []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for at in range(0, len(content), size):
                    file.append(name), number.append(at // size), data.append(content[at: at + size])
            return [file, number, data]
        return run

    return map_batches(spark.read.format("binaryFile").load(path).select("path", "content"), make, BLOCKS)


def write_stream(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """One flat token stream per task, in blocks cut without regard to
    documents; beside them rows with the doc_ids in stream order."""
    def make():
        encode, task = encoder(tokenizer), f"task-{TaskContext.get().partitionId():08d}"
        rest, number, place = b"", 0, 0
        size, end = block * np.dtype(DTYPE).itemsize, np.array([END], DTYPE).tobytes()

        def run(batch):
            nonlocal rest, number, place
            ids, parts = batch.column("doc_id").to_pylist(), [rest]
            for text in texts(batch):
                parts += [np.frombuffer(encode(text), "<u4").astype(DTYPE).tobytes(), end]
            stream = b"".join(parts)
            full = len(stream) // size
            blocks = [stream[i * size: (i + 1) * size] for i in range(full)]
            first, place, rest = place, place + len(ids), stream[full * size:]
            rows = [(task, number + i, b, None, None) for i, b in enumerate(blocks)] + [(task, None, None, first, ids)]
            number += full
            return list(zip(*rows))

        def finish():
            return list(zip((task, number, rest, None, None))) if rest else None

        run.finish = finish
        return run

    return map_batches(docs, make, WRITTEN)


def scan(blocks: DataFrame, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """file, ordinal, start, n_tokens and complete of every document in blocks(file, block, data)."""
    found = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
                          T.StructField("n", T.LongType()), T.StructField("ends", T.ArrayType(T.IntegerType()))])

    def make():
        def run(batch):
            n, ends = [], []
            for data in batch.column("data").to_pylist():
                ids = np.frombuffer(data, dtype)
                n.append(len(ids)), ends.append(np.flatnonzero(ids == end).astype(np.int32))
            return [batch.column("file"), batch.column("block"), n, ends]
        return run

    rows = stash(map_batches(blocks.select("file", "block", "data"), make, found), "ends").withColumn("group", F.floor(F.col("block") / GROUP))
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero, none = F.lit(0), F.lit(-1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(before), zero)).withColumn("nth", F.coalesce(F.sum(F.size("ends")).over(before), zero))
    rows = rows.withColumn("last", F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1)))
    rows = rows.withColumn("previous", F.max("last").over(before))

    groups = rows.groupBy("file", "group").agg(F.sum("n").alias("g_n"), F.sum(F.size("ends")).alias("g_ends"), F.max("last").alias("g_last"))
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("g_at", F.coalesce(F.sum("g_n").over(before), zero)).withColumn("g_nth", F.coalesce(F.sum("g_ends").over(before), zero))
    groups = groups.withColumn("g_previous", F.coalesce(F.max(F.col("g_at") + F.col("g_last")).over(before), none))

    stitched = rows.join(groups, ["file", "group"]).select(
        "file", (F.col("g_at") + F.col("at")).alias("at"), (F.col("g_nth") + F.col("nth")).alias("nth"), "ends",
        F.coalesce(F.col("g_at") + F.col("previous"), F.col("g_previous")).alias("previous"))
    docs = stitched.select("file", "nth", "at", "previous", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("previous") + 1).otherwise(F.col("at") + F.get("ends", F.col("i") - 1) + 1)
    done = docs.select("file", (F.col("nth") + F.col("i")).alias("ordinal"), start.alias("start"),
                       (F.col("at") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    whole = groups.groupBy("file").agg(F.sum("g_n").alias("n"), F.sum("g_ends").alias("ordinal"),
                                       (F.coalesce(F.max(F.col("g_at") + F.col("g_last")), none) + 1).alias("start"))
    rest = whole.where("start < n").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return done.unionByName(rest)


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and its place in the token stream, for every document."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = stash(write_stream(docs, default_path()), "tokens")
    found = scan(written.where("block is not null"))
    named = written.where("block is null").select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return named.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
