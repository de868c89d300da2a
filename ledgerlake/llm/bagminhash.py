"""BagMinHash near-duplicates: weighted Jaccard of word-shingle multisets.

Signature. The weight w of a shingle (how often it occurs) is cut at the levels
[0,1), [1,2), [2,4), [4,8), ... Every level of a shingle has a Poisson process
seeded by shingle and level, with the level's width as its rate; a point has a
time, a component of the signature and a place in the level. Levels wholly
below w keep all points; in the one that holds w a point counts if its place,
found by halving the level down to unit steps, lies below w. A component is the time of its first
point, so two texts agree in it with a probability equal to their weighted
Jaccard similarity. Points later than a bound at which every component should be taken are not
made; a text with a component still free starts anew with twice the bound.

Search. Equal texts count as one. 24 bands of 6 components give buckets; a
bucket's least text is compared with its other texts (a star, never all pairs),
and the multiset overlap of the whole texts decides. Components of these links
leave few buckets with texts of several components. There every text outside
the bucket's largest component is compared with the texts of other components,
in groups of at most about ``BLOCK`` by ``BLOCK`` texts, each pair in the first band
that holds it. So no link between texts that share a bucket is lost to a class.

Defined results: texts with fewer words than a shingle are one shingle; null
texts and texts without words are a class of their own each; repeated rows
share a class; an empty table gives no rows; the class id is the least doc_id."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Cache, map_batches, mix, read, seed, stash, texts, words
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Texts on either side of one group of comparisons.
BLOCK = 512

_STEP = U64(0x9E3779B97F4A7C15)


def _word_hash(w: bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(w)


def word_hashes(limit: int = 100_000) -> Cache:
    return Cache(_word_hash, limit)


def shingles(text: str, hashes: Cache, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles as sorted hashes, and their counts."""
    ws = words(text)
    h = np.fromiter(map(hashes.__getitem__, ws), U64, len(ws))
    if not len(h):
        return h, np.zeros(0, np.int64)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, U64)
    for i in range(n):
        out = mix(out * _STEP + h[i: len(h) - n + 1 + i])
    return np.unique(out, return_counts=True)


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets as of ``shingles``."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - both
    return both / union if union else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """One row of m components (bits of the first times) per non-empty bag."""
    out = np.zeros((len(bags), m), U64)
    todo, factor = np.arange(len(bags)), np.log(m) + 4.0
    while len(todo):
        best = _first_points([bags[i] for i in todo], m, factor)
        done = np.isfinite(best).all(axis=1)
        out[todo[done]] = best[done].view(U64)
        todo, factor = todo[~done], 2 * factor
    return out


def _first_points(bags: list[tuple[np.ndarray, np.ndarray]], m: int, factor: float) -> np.ndarray:
    sizes = np.array([len(d) for d, _ in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    d, w = np.concatenate([x for x, _ in bags]), np.concatenate([x for _, x in bags])
    bound = factor * m / np.add.reduceat(w, np.cumsum(sizes) - sizes)
    best = np.full(len(bags) * m, np.inf)
    level, low, high = 0, 0, 1
    while len(d):
        keep = w > low
        d, w, doc = d[keep], w[keep], doc[keep]
        stream, own, weight, t, steps = mix(d ^ seed(level)), doc, w, np.zeros(len(d)), 1
        while len(stream):
            # the next points of every process: 1, 2, 4, ... of them, alike for every text
            after = stream[:, None] + _STEP * np.arange(1, steps + 1, dtype=U64)
            bits = mix(after)  # 40 bits for the time, 24 for the component
            gap = -np.log((bits >> U64(24)).astype(np.float64) * 2.0 ** -40 + 2.0 ** -41) / (high - low)
            gap[:, 0] += t
            time = np.cumsum(gap, axis=1)
            i, j = np.nonzero(time <= bound[own][:, None])
            if level:  # the first level is one unit wide: all of it lies below any weight
                place = low + ((mix(~after[i, j]) >> U64(11)).astype(np.float64) * 2.0 ** -53 * (high - low)).astype(np.int64)
                i, j = i[place < weight[i]], j[place < weight[i]]
            component = ((bits[i, j] & U64(0xFFFFFF)) * U64(m)) >> U64(24)
            np.minimum.at(best, own[i] * m + component.astype(np.int64), time[i, j])
            live = np.flatnonzero(time[:, -1] <= bound[own])
            stream, own, weight, t, steps = after[live, -1], own[live], weight[live], time[live, -1], 2 * steps
        level, low, high = level + 1, high, 2 * high
    return best.reshape(len(bags), m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(sig), bands)) * _STEP
    for r in range(rows):
        key = mix(key * _STEP + sig[:, r::rows][:, :bands])
    return key.view(np.int64)


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.BinaryType()),
                       T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE, block: int = 50_000) -> DataFrame:
    """prepared documents -> doc_id, node, n_shingles, bands (null without a word)."""
    def make():
        hashes = word_hashes()

        def run(batch):
            ts, keys, count = texts(batch), [None] * batch.num_rows, [0] * batch.num_rows
            at, held, size = [], [], 0

            def flush():
                if held:
                    for i, row in zip(at, band_keys(signatures(held, bands * rows), bands, rows)):
                        keys[i] = row
                at.clear(), held.clear()

            for i, text in enumerate(ts):
                bag = shingles(text, hashes, n)
                if len(bag[0]):
                    at.append(i), held.append(bag)
                    count[i], size = int(bag[1].sum()), size + len(bag[0])
                if size >= block:
                    flush()
                    size = 0
            flush()
            return [batch.column("doc_id"), batch.column("node"), count, keys]
        return run

    return map_batches(docs, make, SIGNED)


def verify(pairs: DataFrame, bodies: DataFrame, tag: str, n: int = SHINGLE) -> DataFrame:
    """pairs(a, b) with the similarity of the whole texts. A leader's multiset
    is kept while its pairs pass by."""
    left = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("sim", T.DoubleType())])

    def make():
        hashes, kept = word_hashes(), OrderedDict()

        def bag(key, text):
            if key not in kept:
                kept[key] = shingles(text, hashes, n)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[key]

        def run(batch):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sim = [overlap(bag(x, s), shingles(t, hashes, n)) for x, s, t in zip(a, texts(batch, "text_a"), texts(batch, "text_b"))]
            return [batch.column("a"), batch.column("b"), sim]
        return run

    return stash(map_batches(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b"), make, schema), tag)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """doc_id, node, member (the class's least text; null without a word),
    class_id, n_verified (the text's links that the search had to verify, which is no
    count of all its partners) for every row of docs."""
    docs = prepared(docs)
    signed = stash(sign(docs, bands, rows, n), "signed")
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("rep"))
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    least = buckets.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    held = stash(buckets.join(least, ["band", "key"]), "buckets")
    pairs = held.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()

    involved = held.select("node").distinct().join(nodes, "node").select(F.col("node").alias("n"), "rep", "bands")
    bodies = stash(docs.join(involved, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("node") == F.col("n")))
                   .groupBy("node").agg(F.first("text").alias("text"), F.first("bands").alias("bands")), "bodies")
    stars = verify(pairs, bodies.select("node", "text"), "stars", n).where(F.col("sim") >= similarity)
    first = stash(components(stars), "first")
    rest = stash(_rest(held, first, bodies, similarity, n), "rest")
    final = components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(rest), "final")
    links = stars.select("a", "b").unionByName(rest)
    links = links.select(*_ordered("a", "b")).distinct()
    count = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_verified"))
    linked = stash(final.join(count, "node"), "linked")

    rows_ = signed.select("doc_id", "node", "n_shingles").join(linked, "node", "left")
    member = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))
    rows_ = rows_.select("doc_id", "node", member.alias("member"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    named = rows_.where("member is not null").groupBy("member").agg(F.min("doc_id").alias("class_id"))
    return (rows_.join(named, "member", "left")
            .select("doc_id", "node", "member", F.when(F.col("member").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_verified"))


def _rest(held: DataFrame, first: DataFrame, bodies: DataFrame, similarity: float, n: int) -> DataFrame:
    """Links (a, b) inside buckets that still hold texts of several components."""
    rows = held.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = rows.groupBy("band", "key", "component").agg(F.count("*").alias("size"))
    mixed = (per.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("size").alias("all"),
                                            F.max(F.struct("size", "component")).alias("most")).where("parts > 1 and all > 2"))
    mixed = mixed.select("band", "key", F.col("most.component").alias("main"),
                         F.ceil((F.col("all") - F.col("most.size")) / BLOCK).alias("n_left"), F.ceil(F.col("all") / BLOCK).alias("n_right"))
    pool = stash(rows.join(mixed, ["band", "key"]).select("band", "key", "node", "component", "n_left", "n_right",
                                                          (F.col("component") != F.col("main")).alias("outside")), "pool")

    def side(rows: DataFrame, left: bool) -> DataFrame:
        """Each row in one block of its side, once per block of the other side."""
        own, other = ("n_left", "n_right") if left else ("n_right", "n_left")
        block, every = F.pmod(F.xxhash64("node"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return rows.select("band", "key", "node", "component", "outside", block.alias("x"), every.alias("y")).select(
            "band", "key", "node", "component", "outside", F.lit(left).alias("is_left"),
            F.col("x" if left else "y").alias("left"), F.col("y" if left else "x").alias("right"))

    sides = side(pool.where("outside"), True).unionByName(side(pool, False)).join(bodies, "node")
    bags, hashes = OrderedDict(), word_hashes(50_000)

    def bag(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        if node not in bags:
            bags[node] = shingles(text, hashes, n)
            if len(bags) > 2 * BLOCK:
                bags.popitem(last=False)
        return bags[node]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        band, left, right = int(pdf["band"].iloc[0]), pdf[pdf["is_left"]], pdf[~pdf["is_left"]]
        keys, component, outside = np.stack(right["bands"].to_list()), right["component"].to_numpy(), right["outside"].to_numpy()
        node = right["node"].to_numpy()
        table = [bag(x, t) for x, t in zip(node, right["text"])]
        size = np.array([c.sum() for _, c in table])
        flat, counts = np.concatenate([h for h, _ in table]), np.concatenate([c for _, c in table])
        owner = np.repeat(np.arange(len(table)), [len(h) for h, _ in table])
        a, b = [], []
        for x, cx, kx, text in zip(left["node"], left["component"], left["bands"], left["text"]):
            mine, mine_n = bag(x, text)
            total = mine_n.sum()
            ask = (component != cx) & (~outside | (node > x)) & ~(keys[:, :band] == kx[:band]).any(axis=1)
            ask &= np.minimum(size, total) >= similarity * np.maximum(size, total)
            if not ask.any():
                continue
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)  # overlaps with all texts of the block at once
            same = np.flatnonzero(mine[at] == flat)
            both = np.bincount(owner[same], np.minimum(mine_n[at[same]], counts[same]), len(table))
            for i in np.flatnonzero(ask & (both >= similarity * (total + size - both))):
                a.append(x), b.append(node[i])
        return pd.DataFrame({"a": a, "b": b})

    return sides.groupBy("band", "key", "left", "right").applyInPandas(compare, "a binary, b binary")


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_verified")


def row_key(doc_id: str, node: str) -> Column:
    return F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.hex(node)))


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs with the least id of each class in rows = classes(docs)
    (of rows equal in id and text the one with the least digest of all its columns), and
    all rows without a word."""
    least = rows.where("member is not null").groupBy("member").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("r"))
    kept = least.select(row_key("r.doc_id", "r.node").alias("key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.md5(F.concat_ws(
        ":", F.col("doc_id").cast("long").cast("string"), F.hex(F.unhex(F.md5(text.cast("binary")))))).alias("key"),
        text.rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    one = keyed.where("worded").join(kept, "key").groupBy("key").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return one.select("row.*").unionByName(keyed.where("not worded").select("row.*"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row with the least id stays (a null id only without another),
    and every row without a word; columns as they come, an empty table stays empty."""
    return keep_one(docs, classes(docs))
