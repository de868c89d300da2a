"""Bigram language model in a log-frequency Bloom filter.

Counts. Tokens are the words of a text, lower-cased A-Z, and one end token; a
text's first word follows the end token. Unigram counts are exact, by 64-bit
hash; of bigrams those seen ``MIN_COUNT`` times or more enter the model.
A task cuts and numbers the words of a run of texts at a time with Arrow, sorts the
run's pairs of numbers and hands their counts on.
Filter. A count n of at least m has level 1 + floor(2 log2(n / m)); its n-gram
enters the filter once per level up to its own, so repeated membership probes
(level 1, 2, ... until a miss) give the quantised count back. It holds the
bigrams, and for every context v that begins one its count c(v) and its escape
count e(v) = c(v) - sum of (c(vw) - ``DISCOUNT``) over its bigrams. The filter consists of
pages; tasks build the pages, and segments of at most ``SEGMENT_BYTES`` of them
are broadcast one at a time: all n-grams of a context lie in one segment, each
position of a text is scored in the pass of its context's segment, and the
number of passes grows with the corpus.
Probability. A bigram in the filter has (c(vw) - DISCOUNT) / (c(v) + MU), any other
word (e(v) + MU) / (c(v) + MU) times its smoothed unigram probability
(c + 1) / (N + V + 1), that alone if v begins no bigram. c(v) is rounded up
within its level and the others down, so together they are at most one.
Unigrams. Words above a count that at most ``HEAD`` words reach are broadcast
(16 bytes each); occurrences of the others join the count table. The levels of a
broadcast word's context and escape counts are probed once a segment, not by every task.

Defined results: a null or empty text is the end token alone; rows without an
id train; repeated rows are scored row by row; without training rows every
probability is one; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import U64, is_fold, map_batches, mix, read, ship, stash

FOLDS, HELD_OUT = 7, 2
MIN_COUNT, DISCOUNT, MU, HEAD = 2, 1.0, 2.0, 1 << 19
PROBES, BITS_PER_ENTRY, PAGE_BITS, SEGMENT_BYTES = 7, 10, 1 << 19, 64 << 20
#: Bytes of text that a task counts at a time and scores at a time, and positions whose pairs it looks up at a time.
COUNTED_BYTES, SCORED_BYTES, PART = 16 << 20, 6 << 20, 400_000

_STEP, _TOP = U64(0x9E3779B97F4A7C15), U64(48)


#: What an entry of the filter counts.
BIGRAM, CONTEXT, ESCAPE = 0, 1, 2


def short(w: np.ndarray) -> np.ndarray:
    """32 bits of a token's hash, as the second word of a bigram."""
    return (w >> U64(32)).astype(np.uint32)


def entry_keys(kind: int, v: np.ndarray, w: np.ndarray | int = 0) -> np.ndarray:
    return mix(v * _STEP + U64(kind)) ^ mix(np.atleast_1d(w).astype(U64) * _STEP + U64(kind))


def levels(n: np.ndarray, least: int = 1) -> np.ndarray:
    """1 + floor(2 log2(n / least))."""
    return 1 + np.floor(2 * np.log2(n / least) + 1e-9).astype(np.int64)


def floor_of(level: np.ndarray, least: int = 1) -> np.ndarray:
    """The least count of a level."""
    return np.ceil(least * 2.0 ** ((level - 1) / 2) - 1e-9)


class Tokens:
    """The tokens of a run of texts, A-Z lower-cased: the text of each (``own``), its
    number (``w``), its context's (``v``), and the numbers' hashes. Number 0 is the end
    token. Arrow cuts the words; its ASCII functions leave all other letters."""

    def __init__(self, texts: pa.Array):
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        found = pc.dictionary_encode(cut.flatten())
        words = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.hash = np.fromiter(map(xxh3_64_intdigest, (b"\n", *words)), U64, len(words) + 1)
        number = found.indices.to_numpy() + np.int32(1)
        own = np.repeat(np.arange(len(texts), dtype=np.int32), cut.value_lengths().to_numpy())
        if b"" in words:  # white space at a text's edge leaves an empty piece
            whole = number != words.index(b"") + 1
            own, number = own[whole], number[whole]
        size = np.bincount(own, minlength=len(texts)) + 1
        self.own, self.w = np.repeat(np.arange(len(texts), dtype=np.int32), size), np.zeros(size.sum(), np.int32)
        self.w[np.arange(len(number)) + own] = number  # after its text's earlier words and an end token for each text before
        self.v = np.concatenate([self.w[-1:], self.w[:-1]])  # every text ends in the end token, so the next one's first word follows it

    def pairs(self, at: np.ndarray | slice) -> np.ndarray:
        return self.v[at].astype(np.int64) << 32 | self.w[at]


def runs(texts: pa.Array, size: int):
    """(first, Tokens) of runs of whole texts of about ``size`` bytes."""
    if len(texts):
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // size
        ends = [*(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
        for first, end in zip([0, *ends], ends):
            yield first, Tokens(texts.slice(first, end - first))


# ---- counts --------------------------------------------------------------------

COUNTED = T.StructType([T.StructField("bigram", T.BooleanType()), T.StructField("v", T.LongType()), T.StructField("w", T.IntegerType()), T.StructField("n", T.LongType())])


def count(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Unigram counts (v) and bigram counts of min_count or more (v, w), over all of docs(text)."""
    def make():
        held, size = [], 0

        def emit():
            nonlocal held, size
            texts, held, size = pa.concat_arrays(held) if held else pa.array([], pa.string()), [], 0
            out = [[np.zeros(0, kind)] for kind in (bool, np.int64, np.int32, np.int64)]
            for _, t in runs(texts, 2 * COUNTED_BYTES):  # one, but of long texts
                own = np.bincount(t.w, minlength=len(t.hash))
                word = np.flatnonzero(own)
                pair = np.sort(t.pairs(slice(None)))
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                n, pair = np.diff(first, append=len(pair)), pair[first]
                v, w = t.hash[pair >> 32], short(t.hash[pair & 0xFFFFFFFF])
                for column, new in zip(out, ((np.zeros(len(word), bool), np.ones(len(v), bool)), (t.hash[word].view(np.int64), v.view(np.int64)),
                                             (np.zeros(len(word), np.int32), w.view(np.int32)), (own[word], n))):
                    column.extend(new)
            return [np.concatenate(column) for column in out]

        def run(batch):
            nonlocal size
            held.append(batch.column("text"))
            size += batch.column("text").nbytes
            return emit() if size >= COUNTED_BYTES else [[], [], [], []]

        run.finish = emit
        return run

    # a run's rows hold a pair once, so a second partial count before the shuffle would find little
    counted = map_batches(docs.select("text"), make, COUNTED).repartition("v", "w").groupBy("bigram", "v", "w").agg(F.sum("n").alias("n"))
    return stash(counted.where(~F.col("bigram") | (F.col("n") >= min_count)), "counts")


# ---- filter --------------------------------------------------------------------

class Filter:
    """Pages of one segment; a context's upper 16 bits name its segment."""

    def __init__(self, pages: np.ndarray, number: int, segments: int):
        self.pages, self.number, self.segments = pages, number, segments
        self.flat = pages.reshape(-1)

    def __reduce__(self):  # the pages travel once
        return Filter, (self.pages, self.number, self.segments)

    def has(self, word: np.ndarray) -> np.ndarray:
        """Whether the words are contexts of this segment."""
        return (word >> _TOP) % U64(self.segments) == U64(self.number)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels of entries of this segment; 0: not in."""
        out, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
        start, j = page_of(keys, len(self.pages)) * self.pages.shape[1], 0
        while len(live):
            j += 1
            base, step = probe_hashes(keys[live], j)
            # a page has 2**k bits, so 32 bits of the running sum name them as 64 do
            hit, at, bit, step, every = live, start[live], base.astype(np.uint32), step.astype(np.uint32), None
            for i in range(PROBES):
                byte = self.flat.take(at + ((bit & np.uint32(PAGE_BITS - 1)) >> np.uint32(3)))
                one = (byte >> (bit & np.uint32(7)).astype(np.uint8)) & np.uint8(1)
                every = one if every is None else every & one
                # the arrays are cut only where that drops a quarter of them: most entries of the first levels are in
                if i + 1 == PROBES:
                    hit = hit[np.flatnonzero(every)]
                elif np.count_nonzero(every) < 0.75 * len(every):
                    yes = np.flatnonzero(every)
                    hit, at, bit, step, every = hit[yes], at[yes], bit[yes], step[yes], None
                bit = bit + step
            out[hit] = j
            live = hit
        return out


def page_of(keys: np.ndarray, pages: int) -> np.ndarray:
    return (mix(keys ^ U64(0x5851F42D4C957F2D)) % U64(pages)).astype(np.int64)


def probe_hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + np.array([level], U64) * _STEP)
    return h >> U64(32), (h & U64(0xFFFFFFFF)) | U64(1)


def entries(counts: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """kind, v, w, n of everything that the filter holds."""
    unigrams, bigrams = counts.where(~F.col("bigram")).select("v", "n"), counts.where("bigram")
    begun = bigrams.groupBy("v").agg(F.sum(F.col("n") - F.lit(float(discount))).alias("used")).join(unigrams, "v")
    none = F.lit(0).alias("w")
    return (bigrams.select(F.lit(BIGRAM).alias("kind"), "v", "w", "n")
            .unionByName(begun.select(F.lit(CONTEXT).alias("kind"), "v", none, "n"))
            .unionByName(begun.select(F.lit(ESCAPE).alias("kind"), "v", none, F.greatest(F.floor(F.col("n") - F.col("used")), F.lit(1)).alias("n"))))


def build(counts: DataFrame, segment_bytes: int = SEGMENT_BYTES, min_count: int = MIN_COUNT, discount: float = DISCOUNT):
    """Yields the segments of the filter, each collected once and bounded by segment_bytes."""
    ship(counts.sparkSession)
    rows = stash(entries(counts, discount), "entries")
    least = F.when(F.col("kind") == BIGRAM, min_count).otherwise(1)
    size = rows.agg(F.sum(F.floor(2 * F.log2(F.col("n") / least) + 1e-9) + 1)).first()[0] or 0
    wanted = max(1, -(-int(size) * BITS_PER_ENTRY // PAGE_BITS))
    segments = max(1, -(-wanted * PAGE_BITS // 8 // segment_bytes))
    pages = -(-wanted // segments)

    def place(batch):
        kind, v, w, n = (batch.column(c).to_numpy() for c in ("kind", "v", "w", "n"))
        v, w = v.view(U64), w.view(np.uint32)
        key, level = np.zeros(len(v), U64), np.zeros(len(v), np.int64)
        for k in (BIGRAM, CONTEXT, ESCAPE):
            of = kind == k
            key[of] = entry_keys(k, v[of], w[of])
            level[of] = levels(n[of], min_count if k == BIGRAM else 1)
        return [page_of(key, pages), key.view(np.int64), level]

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        bits, key, top = np.zeros(PAGE_BITS, np.uint8), pdf["key"].to_numpy().view(U64), pdf["level"].to_numpy()
        for j in range(1, int(top.max()) + 1):
            base, step = probe_hashes(key[top >= j], j)
            for i in range(PROBES):
                bits[((base + U64(i) * step) & U64(PAGE_BITS - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    placed = T.StructType([T.StructField("page", T.LongType()), T.StructField("key", T.LongType()), T.StructField("level", T.LongType())])
    for s in range(segments):
        own = rows.where(F.pmod(F.shiftrightunsigned("v", 48), F.lit(segments)) == s)
        got = map_batches(own, lambda: place, placed).groupBy("page").applyInPandas(page, "page long, bits binary").toPandas()
        table = np.zeros((pages, PAGE_BITS // 8), np.uint8)
        for p, bits in zip(got["page"], got["bits"]):
            table[p] = np.frombuffer(bits, np.uint8)
        yield Filter(table, s, segments)


# ---- scores --------------------------------------------------------------------

TAIL = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("backed", T.LongType())]))
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()),
                       T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
                       T.StructField("tail", TAIL)])


def head_words(unigrams: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of all words above a count that at most ``size`` words reach."""
    bucket = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for b, n in sorted(unigrams.groupBy(bucket.alias("b")).count().collect(), reverse=True):  # some 8 x 64 rows
        total += n
        if total > size:
            break
        least = b
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    table = unigrams.where(bucket >= least).select("v", "n").toPandas()
    key = table["v"].to_numpy().view(U64)
    order = np.argsort(key)
    return key[order], table["n"].to_numpy()[order]


def _flat_tail(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Row, key, n and backed of every entry of a tail column."""
    flat = column.flatten()
    size = column.value_lengths().fill_null(0).to_numpy()
    return (np.repeat(np.arange(len(column)), size), *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("key", "n", "backed")))


def _tail_column(parts: list[tuple[np.ndarray, ...]], rows: int) -> pa.Array:
    row, *values = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row.astype(np.int64), minlength=rows))
    entries = pa.StructArray.from_arrays([pa.array(v[order]) for v in values], ["key", "n", "backed"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), entries)


def context_levels(word: np.ndarray, f: Filter) -> np.ndarray:
    """Levels (2, n) of the context and escape counts of words; 0 of those that begin no bigram of the filter's segment."""
    out, mine = np.zeros((2, len(word)), np.int16), np.flatnonzero(f.has(word))
    out[0, mine] = f.level(entry_keys(CONTEXT, word[mine]))
    begins = mine[out[0, mine] > 0]
    out[1, begins] = f.level(entry_keys(ESCAPE, word[begins]))
    return out


class Known:
    """What is known of words given by their hashes: unigram share, and for contexts
    of the filter's segment the weight of leaving them and their count. The levels of
    ``head``'s words (``begun``) were probed once for all tasks, those of others are here."""

    def __init__(self, word: np.ndarray, f: Filter, head: tuple, begun: np.ndarray, total: int):
        key, n = head
        at = np.minimum(np.searchsorted(key, word), max(0, len(key) - 1))
        frequent = key[at] == word if len(key) else np.zeros(len(word), bool)
        c, level = np.zeros(len(word), np.int64), np.zeros((2, len(word)), np.int16)
        c[frequent], level[:, frequent] = n[at[frequent]], begun[:, at[frequent]]
        level[:, ~frequent] = context_levels(word[~frequent], f)
        self.known, self.unigram = c > 0, np.log10((c + 1) / total)
        self.mine = f.has(word)
        level, escape = level.astype(np.int64)
        self.begins, self.count, self.away = level > 0, floor_of(level + 1) - 1, np.zeros(len(word))
        self.away[self.begins] = np.minimum(0.0, np.log10((floor_of(np.maximum(1, escape[self.begins])) + MU) / (self.count[self.begins] + MU)))


def _pass(rows: DataFrame, filter_: Filter, head: tuple, total: int, last: bool, min_count: int, discount: float) -> DataFrame:
    """Adds the positions whose context lies in the filter's segment; the first
    pass also counts, and what needs a rarer word's count goes to ``tail``."""
    sc = rows.sparkSession.sparkContext
    shared_filter, shared_head = sc.broadcast(filter_), sc.broadcast((head, context_levels(head[0], filter_)))

    def make():
        f = shared_filter.value
        first = f.number == 0

        def run(batch):
            texts = batch.column("text")
            sums, tail = np.zeros((4, len(texts))), [_flat_tail(batch.column("tail"))]
            for start, t in runs(texts, SCORED_BYTES):
                know = Known(t.hash, f, *shared_head.value, total)
                known, mine = know.known[t.w], know.mine[t.v]
                base = np.where(known, know.unigram[t.w], 0.0)
                score = np.where(mine, know.away[t.v] + base, 0.0)
                tried, found = np.flatnonzero(know.begins[t.v]), np.zeros(len(t.w), bool)  # positions whose context begins a bigram
                for i in range(0, len(tried), PART):
                    at = tried[i:i + PART]
                    of, pair = pd.factorize(t.pairs(at))
                    context, word = pair >> 32, pair & 0xFFFFFFFF
                    level = f.level(entry_keys(BIGRAM, t.hash[context], short(t.hash[word])))
                    share = np.log10(np.clip((floor_of(np.maximum(1, level), min_count) - discount) / (know.count[context] + MU), 1e-300, 1.0))
                    seen = level[of] > 0
                    score[at[seen]] = share[of[seen]]
                    found[at[seen]] = True
                own = t.own + np.int32(start)
                for k, x in enumerate((None, known, base, score) if first else (score,)):
                    sums[k if first else 3] += np.bincount(own, x, len(texts))
                rare = np.flatnonzero(~known & (first | mine & ~found))
                if len(rare):
                    back, key = pd.factorize(own[rare].astype(np.int64) << 32 | t.w[rare])
                    tail.append((key >> 32, t.hash[key & 0xFFFFFFFF].view(np.int64), np.bincount(back) * int(first),
                                 np.bincount(back, (mine & ~found)[rare]).astype(np.int64)))
            before = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_tokens", "n_known", "base_score", "score")]
            sums = [b + s for b, s in zip(before, sums)]
            return [batch.column("doc_id"), [None] * len(texts) if last else texts,
                    sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], sums[3], _tail_column(tail, len(texts))]
        return run

    return map_batches(rows, make, SCORED, rows=8192)  # a run of texts is cut by size, so it may span many rows


def score(docs: DataFrame, train: Column, head: int = HEAD, segment_bytes: int = SEGMENT_BYTES, min_count: int = MIN_COUNT,
          discount: float = DISCOUNT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of docs(doc_id, text), learnt from the rows of ``train``."""
    counts = count(docs.where(train), min_count)
    unigrams = counts.where(~F.col("bigram"))
    n, v = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top, total = head_words(unigrams, head), n + v + 1
    rows = docs.select("doc_id", "text", *(F.lit(0).cast(f.dataType).alias(f.name) for f in SCORED[2:6]), F.array().cast(TAIL).alias("tail"))
    segments = iter(build(counts, segment_bytes, min_count, discount))
    part = next(segments)
    while part is not None:
        following = next(segments, None)
        rows = _pass(rows, part, top, total, following is None, min_count, discount)
        if following is not None:
            rows = stash(rows, "scored")
        part = following
    rows = stash(rows.drop("text").withColumn("row", F.monotonically_increasing_id()), "scored")

    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    known = tail.join(unigrams.select(F.col("v").alias("key"), F.col("n").alias("c")), "key", "left")
    p = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total)))
    more = known.groupBy("row").agg(F.sum(F.col("n") * p).alias("base_more"), F.sum(F.col("backed") * p).alias("score_more"),
                                    F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_more"))
    zero = F.lit(0)
    return rows.drop("tail").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known_more", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base_more", zero)).alias("base_score"), (F.col("score") + F.coalesce("score_more", zero)).alias("score"))


def op10_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = is_fold("doc_id", FOLDS, HELD_OUT)
    out = score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), *out.columns[1:])
