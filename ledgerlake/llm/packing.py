"""Best-fit-decreasing packing of documents into fixed-length sequences.

A document's tokens are its ids and one end id; only documents longer than a
sequence are cut, into full pieces and a shorter last one. Pieces are dealt
into shards of about ``SHARD`` pieces by their place in the input (so no
document, source or repeated row can gather in one of them), and every shard is
packed by itself: longest piece first, each into the tightest open sequence,
found in a segment tree over remaining capacities. A shard leaves at most a
few sequences less full than one packing of everything would.

Defined results: null and empty texts are one piece with the end id alone;
repeated rows and ties are packed row by row; an empty table gives no rows;
further columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, read, ship, stash, texts
from .tokens import default_path, encoder

CAPACITY, SHARD, END = 2048, 8192, 0

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("task", T.IntegerType()), T.StructField("place", T.LongType())])


class CapacityTree:
    """Open bins by remaining capacity; a segment tree over the capacities
    0..size counts them, so the least capacity of at least n that has an open
    bin is found in logarithmic time."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def push(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._add(capacity, 1)

    def tightest(self, need: int) -> int:
        """Least capacity >= need with an open bin, or -1."""
        i, count = need + self.leaves, self.count
        while not count[i]:
            while i & 1:  # a right child: what lies further right is above
                i >>= 1
            if not i:
                return -1
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.leaves

    def pop(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.bins[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    tree, n_bins = CapacityTree(capacity), 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = tree.tightest(need)
        if room < 0:
            b, room, n_bins = n_bins, capacity, n_bins + 1
        else:
            b = tree.pop(room)
        bins[k], offsets[k] = b, capacity - room
        if room > need:
            tree.push(room - need, b)
    return bins, offsets


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with its place in the input."""
    def make():
        encode, task, place = encoder(tokenizer), TaskContext.get().partitionId(), 0

        def run(batch):
            nonlocal place
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = encode(text) + END.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    for col, v in zip(cols, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), place)):
                        col.append(v)
                    place += 1
            return [*cols[:5], [task] * len(cols[0]), cols[5]]
        return run

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, make, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset. ``pieces`` must be a written table: its
    rows are dealt by task and place."""
    ship(pieces.sparkSession)
    shards = max(1, -(-pieces.count() // shard))
    out = T.StructType([f for f in pieces.schema if f.name not in ("task", "place")]
                       + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "task", "place"], ascending=[False, True, True], ignore_index=True)
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"], pdf["offset"] = (np.int64(pdf["shard"].iloc[0]) << 32) + bins, offsets
        return pdf[out.fieldNames()]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("task", "place"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, out)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(stash(cut(docs, tokenizer or default_path(), capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every row of docs; a null or empty text is one piece of the end id,
    repeated rows are packed each, an empty table gives no rows."""
    return pack_documents(docs)
