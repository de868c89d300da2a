"""Merkle manifest of a table: one ternary hash tree per group, one over the groups.

Leaves are numbered within their group across range partitions, and aligned
builders take 3^``LEVELS`` consecutive nodes each. A builder appends every
node when it is complete (children before parents), so a segment of the log is
in postorder and a node's place follows from subtree sizes alone (``place``):
proofs are read out of the segment by computed positions, without pointers.
Roots of the segments are the leaves of the next tier, built the same way until
each group has one node; the groups' roots form a last tree. Proof paths then
run down the tiers, one row per segment, and meet the documents in the lowest.

While several nodes remain, each run of three (the last one shorter, even a
single node) is hashed into its parent: H of the children's digests as hex text.

Defined results: null values of a leaf read ``-``; a null group comes first and
is a group of its own; rows of a group ascend by their order column, nulls
first, ties by leaf digest, so equal rows stand side by side; a group's only
leaf is its root; an empty table gives no segments and no proofs; long texts
are hashed whole; columns that aren't named are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_batches, read, ship, stash

FAN, LEVELS = 3, 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(hexes: Sequence[bytes]) -> bytes:
    """H of child digests (hex text), as hex text."""
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


# ---- the postorder log ---------------------------------------------------------

def height(n: int) -> int:
    """Levels until one node is left of n."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def start(leaf, h: int):
    """Nodes of the levels 0..h that are complete before this leaf is appended."""
    return sum(leaf // FAN ** j for j in range(h + 1))


def place(level: int, i, n: int, h: int):
    """Place in the log of node i of a level, in a tree of n leaves and height h:
    what is complete before its subtree, and the subtree's size. Takes arrays."""
    first = i * FAN ** level
    span = np.minimum(FAN ** level, n - first)
    return start(first, h) + sum(-(-span // FAN ** j) for j in range(level + 1)) - 1


def append_log(leaves: Sequence[bytes], h: int) -> list[bytes]:
    """The nodes of a tree of height h in the order in which they are complete."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(h + 1)]

    def add(level: int, digest: bytes) -> None:
        log.append(digest)
        open_[level].append(digest)
        if level < h and len(open_[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        children, open_[level] = open_[level], []
        add(level + 1, digest_of(children))

    for leaf in leaves:
        add(0, leaf)
    for level in range(h):
        if open_[level]:
            close(level)
    return log


def paths(log: Sequence[bytes], n: int, h: int) -> list[list[tuple[bytes, bytes]]]:
    """For every leaf, level by level, its run's digests left and right of it."""
    steps: list[list[tuple[bytes, bytes]]] = []
    for level in range(h):
        m = -(-n // FAN ** level)
        at = [log[p] for p in place(level, np.arange(m, dtype=np.int64), n, h).tolist()]
        here = []
        for run in range(0, m, FAN):
            of = at[run:run + FAN]
            here += [(b"".join(of[:k]), b"".join(of[k + 1:])) for k in range(len(of))]
        steps.append(here)
    return [[steps[level][i // FAN ** level] for level in range(h)] for i in range(n)]


def encode(path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: per level the counts left and right, then the digests."""
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + bytes.fromhex((a + b).decode()) for a, b in path)


def decode(data: bytes) -> list[tuple[bytes, bytes]]:
    path, at = [], 0
    while at < len(data):
        left, right = data[at], data[at + 1]
        at += 2
        mid, end = at + 32 * left, at + 32 * (left + right)
        path.append((data[at:mid].hex().encode(), data[mid:end].hex().encode()))
        at = end
    return path


def fold(leaf: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = digest_of((left, leaf, right))
    return leaf


# ---- leaves and their numbers --------------------------------------------------

def leaf_digest(columns: Sequence[Column]) -> Column:
    """H of the values, each as UTF-8 byte count, ``:`` and value, or ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def number(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows (a string column ``grp`` among them) with ``idx`` from 0 within their
    group in this order and the group's count ``n``. Rows are sorted across range
    partitions; a group's offset in a partition comes from the partitions' counts."""
    by = ["grp", *order, "seq"]
    sorted_ = rows.withColumn("seq", F.monotonically_increasing_id()).repartitionByRange(*[F.col(c).asc_nulls_first() for c in by])
    sorted_ = sorted_.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by]).drop("seq")
    sorted_ = stash(sorted_.withColumn("spot", F.monotonically_increasing_id()).withColumn("pid", F.spark_partition_id()), "merkle-sorted")
    runs = sorted_.groupBy("pid", "grp").agg(F.min("spot").alias("first"), F.count("*").alias("here"))
    w = Window.partitionBy("grp")  # a row per partition that holds the group
    runs = runs.withColumns({"n": F.sum("here").over(w), "upto": F.sum("here").over(w.orderBy("pid")) - F.col("here")}).drop("here")
    return sorted_.join(runs, ["pid", "grp"]).withColumn("idx", F.col("spot") - F.col("first") + F.col("upto")).drop("pid", "spot", "first", "upto")


# ---- aligned builders ----------------------------------------------------------

def _segments(nodes: DataFrame, tier: int, levels: int) -> DataFrame:
    """One log segment per aligned block of ``nodes`` (grp, idx, n, digest, item)."""
    width = FAN ** levels
    item = nodes.schema["item"].dataType
    schema = T.StructType([
        T.StructField("grp", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("block", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("size", T.LongType()), T.StructField("height", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("nodes", T.BinaryType()), T.StructField("root", T.BinaryType()),
        T.StructField("items", T.ArrayType(item))])
    types = to_arrow_schema(schema)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx").combine_chunks()
        n, m = table.column("n")[0].as_py(), table.num_rows
        block = table.column("block")[0].as_py()
        h = height(n) if n <= width else levels
        log = append_log([d.hex().encode() for d in table.column("digest").to_pylist()], h)
        data = bytes.fromhex(b"".join(log).decode())
        items = table.column("item").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        columns = [[table.column("grp")[0].as_py()], [tier], [block], [n], [m], [h], [start(block * width, height(n))], [data], [data[-32:]],
                   pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), items).cast(types.field("items").type)]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    ship(nodes.sparkSession)
    return nodes.withColumn("block", F.floor(F.col("idx") / width)).groupBy("grp", "block").applyInArrow(build, schema)


def build_tiers(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Log segments, lowest tier first, until every group has one node. The
    number of tiers is the logarithm of the largest group to the base 3^levels."""
    width = FAN ** levels
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = []
    while True:
        tiers.append(stash(_segments(nodes, len(tiers), levels), f"merkle-log-{len(tiers)}"))
        if most <= width:
            return tiers
        most = -(-most // width)
        nodes = tiers[-1].select("grp", F.col("block").alias("idx"), F.ceil(F.col("n") / width).alias("n"),
                                 F.col("root").alias("digest"), F.struct(F.lit(0).alias("none")).alias("item"))


def _descend(segments: DataFrame, keep: Sequence[str], levels: int) -> DataFrame:
    """Segments with the ``path`` above them -> a row per entry: its index in its
    tier, its digest, its item, its whole path, and the columns to keep."""
    width = FAN ** levels
    fields = [T.StructField("grp", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("digest", T.BinaryType()),
              T.StructField("path", T.BinaryType()), T.StructField("item", segments.schema["items"].dataType.elementType),
              *[segments.schema[c] for c in keep]]

    def make():
        def run(batch):
            out = [[] for _ in range(4)]
            sizes = batch.column("size").to_numpy()
            for grp, block, size, h, nodes, above in zip(*[batch.column(c).to_pylist() for c in ("grp", "block", "size", "height", "nodes", "path")]):
                text = nodes.hex().encode()
                log = [text[i:i + 64] for i in range(0, len(text), 64)]
                leaf = place(0, np.arange(size, dtype=np.int64), size, h).tolist()
                out[0] += [grp] * size
                out[1] += range(block * width, block * width + size)
                out[2] += [nodes[32 * p:32 * p + 32] for p in leaf]
                out[3] += [encode(p) + above for p in paths(log, size, h)]
            items = batch.column("items")
            return [*out, items.flatten(), *[batch.column(c).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for c in keep]]
        return run

    return map_batches(segments, make, T.StructType(fields), rows=1)


@dataclass
class Manifest:
    """The logs of the groups' trees and of the tree over the groups."""
    groups: list[DataFrame]
    top: list[DataFrame]
    levels: int = LEVELS

    def proofs(self) -> DataFrame:
        """A row per leaf: grp, idx, digest, item, path (all siblings up to the
        root), subroot and root."""
        empty = F.lit(b"")
        above = self.top[-1].withColumns({"path": empty, "top": F.col("root")})
        for lower in reversed(self.top[:-1]):
            at = _descend(above, ["top"], self.levels).select(F.col("idx").alias("block"), "path", "top")
            above = lower.join(at, "block")
        roots = _descend(above, ["top"], self.levels).select(F.col("item.grp").alias("grp"), "path", "top", F.col("digest").alias("subroot"))
        segments = self.groups[-1].join(stash(roots, "merkle-roots"), "grp")
        for lower in reversed(self.groups[:-1]):
            at = _descend(segments, ["top", "subroot"], self.levels).select("grp", F.col("idx").alias("block"), "path", "top", "subroot")
            segments = lower.join(stash(at, "merkle-paths"), ["grp", "block"])
        return _descend(segments, ["subroot", "top"], self.levels).withColumnRenamed("top", "root")


def manifest(leaves: DataFrame, order: Sequence[str], levels: int = LEVELS) -> Manifest:
    """Build the logs over ``leaves``: grp (string), digest (binary), item (struct)
    and the columns that order a group's leaves."""
    groups = build_tiers(number(stash(leaves, "merkle-leaves"), order).drop(*order), levels)
    roots = groups[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"), F.struct("grp").alias("item"))
    return Manifest(groups, build_tiers(number(roots, ["name"]).drop("name"), levels), levels)


# ---- the query -----------------------------------------------------------------

def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by source and doc_id; the item holds the id and, where
    2 divides the crc32 of the decimal id and the text holds a \\n, the leaf of
    the text without them."""
    tampered = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return docs.select(*COLUMNS).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("grp"),  # null before all others
        F.col("doc_id").alias("id"), leaf_digest([F.col(c) for c in COLUMNS]).alias("digest"),
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.when(hit, leaf_digest(tampered)).alias("tampered")).alias("item")
    ).withColumn("tie", F.col("digest"))


def op11_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = manifest(document_leaves(read(spark, sf_dir, "documents")), ["id", "tie"]).proofs()
    text = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *text, T.StructField("verified", T.BooleanType())])

    def make():
        def run(batch):
            items, rows = batch.column("item"), []
            for leaf, other, path, subroot, root in zip(*[c.to_pylist() for c in (
                    batch.column("digest"), items.field("tampered"), batch.column("path"), batch.column("subroot"), batch.column("root"))]):
                steps = decode(path)
                folded = fold((other or leaf).hex().encode(), steps).decode()
                rows.append((leaf.hex(), subroot.hex(), root.hex(), digest_of([s for step in steps for s in step]).decode(), folded, folded == root.hex()))
            return [items.field("doc_id"), *(zip(*rows) if rows else [[]] * 6)]
        return run

    return map_batches(proofs, make, schema)


def oracle() -> str:
    """The contract in DuckDB SQL: trees grow by a recursion over levels, then a
    recursion walks every leaf up, gathering siblings and folding."""
    value = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = "sha256(" + " || ".join(value.format(c) for c in COLUMNS) + ")"
    torn = "sha256(" + " || ".join(value.format(f"replace({c}, chr(10), '')" if c == "text" else c) for c in COLUMNS) + ")"
    return f"""
WITH RECURSIVE d AS (SELECT *, {leaf} AS leaf,
  CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN {torn} ELSE {leaf} END AS torn FROM documents),
l AS (SELECT coalesce('s' || source, '') AS g, leaf, torn, doc_id,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
tree AS (SELECT g, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL SELECT g, lvl + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, lvl, i // 3),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, i, n, h FROM sub
  UNION ALL SELECT lvl + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3),
fam AS (SELECT g, lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY ALL),
tfam AS (SELECT lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY ALL),
walk AS (SELECT i AS r, g, 0 AS lvl, i, torn AS cur, '' AS sib FROM l
  UNION ALL SELECT r, g, w.lvl + 1, i // 3,
    sha256(array_to_string(hs[1:i % 3], '') || cur || array_to_string(hs[i % 3 + 2:], '')),
    sib || array_to_string(hs[1:i % 3], '') || array_to_string(hs[i % 3 + 2:], '')
  FROM walk w JOIN fam f USING (g) WHERE f.lvl = w.lvl AND f.run = w.i // 3),
done AS (SELECT r, g, arg_max(cur, lvl) AS cur, arg_max(sib, lvl) AS sib FROM walk GROUP BY r, g),
up AS (SELECT r, g, 0 AS lvl, s.i, cur, sib FROM done JOIN sub s USING (g)
  UNION ALL SELECT r, g, w.lvl + 1, i // 3,
    sha256(array_to_string(hs[1:i % 3], '') || cur || array_to_string(hs[i % 3 + 2:], '')),
    sib || array_to_string(hs[1:i % 3], '') || array_to_string(hs[i % 3 + 2:], '')
  FROM up w JOIN tfam f ON f.lvl = w.lvl AND f.run = w.i // 3),
fin AS (SELECT r, g, arg_max(cur, lvl) AS cur, arg_max(sib, lvl) AS sib FROM up GROUP BY r, g),
whole AS (SELECT *, (SELECT h FROM top WHERE n = 1) AS root FROM fin)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM l JOIN whole w ON w.g = l.g AND w.r = l.i JOIN sub s ON s.g = l.g"""


def crc32_sql(text: str) -> str:
    """DuckDB: unsigned crc32 of an ASCII text (0xEDB88320 reflected, bit by bit; -1 shifts)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {steps}), "
            "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))")
