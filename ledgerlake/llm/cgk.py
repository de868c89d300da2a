"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Symbols are words, lower-cased and without marks at their ends. An item is
found in a document if some window of the item's word count lies within
``floor(RATE * words)`` word edits of it.

Windows. With k edits an item of n words keeps a run of at least
n // (k + 1) words (pigeonhole), so only windows that put such an anchor within k
places of its place in the item can match; runs of three words serve when the
rate is 0.2 and items have 15 words or more, shorter items use what they have.
A word of no item costs an edit, so windows with more than k of them go too.
Embedding. The CGK random walk copies a window's symbols to an output string
twice as long (where the walk ends on average: later places would mostly agree
for any two texts), moving on after a symbol by a random bit of (step, symbol);
texts a few edits apart give strings of small Hamming distance.
Search. Each table samples ``SAMPLE`` places of an embedding (one of ``WALKS``
walks) and hashes them; a window that meets an item in any table is a
candidate. A place agrees with a probability that falls with the item's length,
so the number of tables is chosen for each size: the least of ``TABLES`` at which
the measured share of pairs at the edit limit that meet is at least ``TARGET``.
Where none suffices (long items) candidates come from an exact rule instead: with
k edits a window keeps all but n * k of an item's runs of n words, hence one of
its rarest n * k + 1, and shares at least the rest.
Check. The exact word edit distance decides.

Items come to the tasks in blocks of at most ``BLOCK`` items, each an index that the
driver builds once and broadcasts as arrays; the documents pass once per block. Items without a word are never found.

Defined results: null and empty texts hold nothing; repeated rows are searched
row by row; items of equal text but other ids are reported each, a repeated row of the
benchmark once; an empty benchmark or table gives no hits; of an item's overlapping windows in a document the closest, then
first, is reported once."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Cache, map_batches, mix, read, seed, stash, words

RATE, ANCHOR = 0.2, 3
WALKS, TABLES, SAMPLE, STRETCH = 8, (32, 48, 64, 96), 3, 2
TARGET, PAIRS, LONG = 0.98, 400, 50
BLOCK = 20_000

HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()),
                    T.StructField("n_words", T.LongType()), T.StructField("distance", T.LongType())])

_MARKS = re.compile(r"^[\W_]+|[\W_]+$")


def symbol(w: bytes) -> str:
    s = w.decode("utf-8").lower()
    return s if s.isalnum() else _MARKS.sub("", s) or s


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two symbol arrays, a row at a time."""
    row, steps = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def distances(a: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distance of symbol array a to the first ``lengths`` symbols of each row."""
    steps = np.arange(rows.shape[1] + 1)
    row = np.tile(steps, (len(rows), 1))
    for i, x in enumerate(a, 1):
        new = np.full_like(row, i)
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (rows != x), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[np.arange(len(rows)), lengths]


def limit(size: int, rate: float = RATE) -> int:
    """Edits an item of ``size`` words may have."""
    return int(rate * size + 1e-9)


def embed(windows: np.ndarray, walk: int, length: int) -> np.ndarray:
    """CGK embedding of symbol rows (unsigned 64 bit): length places each."""
    n, width = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), U64)], axis=1)
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.zeros((n, length), U64)
    for step in range(length):
        out[:, step] = here = padded[rows, at]
        at = np.minimum(at + (mix(here ^ seed(walk * 100_003 + step)) & U64(1)).astype(np.int64), width)
    return out


def _places(size: int, tables: int) -> list[np.ndarray]:
    rng = np.random.default_rng(9)
    return [rng.choice(STRETCH * size, min(SAMPLE, STRETCH * size), replace=False) for _ in range(tables)]


def _keys(windows: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Rows of table keys."""
    out = np.zeros((len(windows), len(places)), U64)
    for walk in range(WALKS):
        e = embed(mix(windows + U64(1)), walk, STRETCH * windows.shape[1])
        for t in range(walk, len(places), WALKS):
            for p in places[t]:
                out[:, t] = mix(out[:, t] * U64(0x9E3779B97F4A7C15) + e[:, p])
    return out


@lru_cache(maxsize=None)
def _measured(size: int, rate: float) -> int:
    """The least of TABLES at which pairs at the edit limit meet often enough; 0: none."""
    rng, pairs = np.random.default_rng(size), np.zeros((2, PAIRS, size), np.int64)
    for i in range(PAIRS):
        new = iter(range(size + 1, 4 * size + 2))
        a = list(range(1, size + 1))
        b = a[:]
        for _ in range(limit(size, rate)):
            at, kind = int(rng.integers(len(b))), rng.integers(3)  # replaced, added, taken out
            b[at: at + (kind != 1)] = [next(new)] if kind < 2 else []
        b += [next(new) for _ in range(size - len(b))]
        pairs[:, i] = np.array([a, b[:size]]) + 4 * i * (size + 1)
    places = _places(size, max(TABLES))
    met = np.logical_or.accumulate(_keys(pairs[0].astype(U64), places) == _keys(pairs[1].astype(U64), places), axis=1).mean(axis=0)
    return next((t for t in TABLES if met[t - 1] >= TARGET), 0)


def tables_for(size: int, rate: float = RATE) -> int:
    """Tables for items of ``size`` words, 0 for the exact rule. Measured at the next
    multiple of five, where the edit limit is the largest share of the words; beyond
    the first size of ``LONG`` words or more that no number of tables serves, none is tried."""
    top = -(-size // 5) * 5
    return 0 if any(not _measured(n, rate) for n in range(LONG, top, 5)) else _measured(top, rate)


class Index:
    """Tables over the embeddings of one block of items, or their rarest runs."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, plan: dict[int, int] | None = None):
        self.rate = rate
        self.number: dict[str, int] = {}
        self.items = []
        for item, text in items:
            ws = [symbol(w) for w in words(text or "")]
            if ws:
                self.items.append((item, np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64)))
        self.by_size: dict[int, dict] = {}
        sizes = defaultdict(list)
        for i, (_, ids) in enumerate(self.items):
            sizes[len(ids)].append(i)
        for size, held in sizes.items():
            tables = plan[size] if plan else tables_for(size, rate)
            self.by_size[size] = self._tables(size, held, tables) if tables else self._rarest(size, held)
        self.runs = self._anchors()

    def _tables(self, size: int, held: list[int], tables: int) -> dict:
        places = _places(size, tables)
        keys = _keys(np.stack([self.items[i][1] for i in held]).astype(U64), places)
        order = np.argsort(keys, axis=0, kind="stable")
        return {"places": places, "keys": np.take_along_axis(keys, order, axis=0), "who": np.array(held)[order]}

    def _rarest(self, size: int, held: list[int]) -> dict:
        """Per item the rarest runs, of which a match keeps one, in order of their codes."""
        n, base = self._run(size), len(self.number) + 1
        codes = np.stack([_run_codes(self.items[i][1], n, base) for i in held])
        shared = max(1, codes.shape[1] - n * self.edits(size))  # runs that k edits leave, each edit touching n at most
        _, inverse, count = np.unique(codes, return_inverse=True, return_counts=True)
        order = np.argsort(count[inverse.reshape(codes.shape)], axis=1, kind="stable")[:, : codes.shape[1] - shared + 1]
        rare, who = np.take_along_axis(codes, order, axis=1).ravel(), np.repeat(held, order.shape[1])
        at = np.lexsort((who, rare))
        return {"n": n, "shared": shared, "rare": rare[at], "who": who[at], "codes": dict(zip(held, codes))}

    def edits(self, size: int) -> int:
        return limit(size, self.rate)

    def _run(self, size: int) -> int:
        """Words of the runs that serve as anchors."""
        return min(ANCHOR, max(1, size // (self.edits(size) + 1)))

    def _anchors(self) -> dict[int, dict]:
        """Run length -> its runs' codes in order, and where they stand: from ``first`` on, (size, offset) rows."""
        held: dict[int, set] = {}
        base = len(self.number) + 1
        for _, ids in self.items:
            n = self._run(len(ids))
            held.setdefault(n, set()).update((code, len(ids), o) for o, code in enumerate(_run_codes(ids, n, base).tolist()))
        out = {}
        for n, runs in held.items():
            rows = np.array(sorted(runs), np.int64)
            codes, first = np.unique(rows[:, 0], return_index=True)
            out[n] = {"codes": codes, "first": np.append(first, len(rows)), "at": rows[:, 1:]}
        return out

    def windows(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(start, size) of the windows that anchors admit; ids 0: not a word of any item."""
        out: set[tuple[int, int]] = set()
        base = len(self.number) + 1
        for n, runs in self.runs.items():
            if len(ids) < n:
                continue
            known = ids > 0
            full = known[: len(ids) - n + 1].copy()
            for i in range(1, n):
                full &= known[i: len(ids) - n + 1 + i]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            codes = _run_codes(ids, n, base)[at]
            near = np.searchsorted(runs["codes"], codes)
            hit = runs["codes"][np.minimum(near, len(runs["codes"]) - 1)] == codes
            low, high = runs["first"][near[hit]], runs["first"][near[hit] + 1]
            where = runs["at"][_spans(low, high)]
            starts = set(zip((np.repeat(at[hit], high - low) - where[:, 1]).tolist(), where[:, 0].tolist()))
            foreign = np.concatenate([[0], np.cumsum(~known)])
            for start, size in starts:
                k = self.edits(size)
                # a window past either end is cut to the text
                for s in range(max(0, start - k), min(start + k, max(0, len(ids) - size)) + 1):
                    if foreign[min(s + size, len(ids))] - foreign[s] <= k:
                        out.add((s, size))
        return out

    def search(self, docs: list[np.ndarray]) -> list[list[dict]]:
        """Per document (its ids) the items found."""
        by_size = defaultdict(list)
        for d, ids in enumerate(docs):
            for start, size in self.windows(ids):
                by_size[size].append((d, start))
        best: list[dict[int, tuple]] = [{} for _ in docs]
        for size, held in by_size.items():
            held.sort()
            for at in range(0, len(held), 4096):
                part = held[at: at + 4096]
                rows = np.zeros((len(part), size), U64)
                for r, (d, s) in enumerate(part):
                    w = docs[d][s: s + size]
                    rows[r, : len(w)] = w
                self._match(part, rows, size, docs, best)
        return [[dict(zip(HIT.fieldNames(), (self.items[i][0], s, n, dist))) for i, (dist, s, n) in sorted(b.items())] for b in best]

    def _match(self, part, rows, size, docs, best) -> None:
        index = self.by_size[size]
        lengths = np.array([min(size, len(docs[d]) - s) for d, s in part])
        windows = rows.astype(np.int64)
        for i, at in (self._met(rows, index) if "places" in index else self._sharing(windows, index)).items():
            for r, dist in zip(at, distances(self.items[i][1], windows[at], lengths[at]).tolist()):
                if dist <= self.edits(size):
                    d, s = part[r]
                    best[d][i] = min(best[d].get(i, (size + 1,)), (dist, s, int(lengths[r])))

    def _met(self, rows: np.ndarray, index: dict) -> dict[int, list[int]]:
        """Item -> rows that meet it in a table."""
        keys, met = _keys(rows, index["places"]), []
        for t in range(keys.shape[1]):
            low, high = (np.searchsorted(index["keys"][:, t], keys[:, t], side) for side in ("left", "right"))
            met.append(index["who"][_spans(low, high), t] * len(rows) + np.repeat(np.arange(len(rows)), high - low))
        who, at = np.divmod(np.unique(np.concatenate(met)), len(rows))
        items, first = np.unique(who, return_index=True)
        return {i: x.tolist() for i, x in zip(items.tolist(), np.split(at, first[1:]))}

    def _sharing(self, windows: np.ndarray, index: dict) -> dict[int, list[int]]:
        """Item -> rows that hold one of its rarest runs and enough of all its runs."""
        base, out = len(self.number) + 1, defaultdict(list)
        for at in range(0, len(windows), 256):
            codes = _run_codes(windows[at: at + 256].T, index["n"], base).T
            low, high = (np.searchsorted(index["rare"], codes, side) for side in ("left", "right"))
            r, c = np.nonzero(high > low)
            times = (high - low)[r, c]
            who = index["who"][_spans(low[r, c], high[r, c])]
            for i in np.unique(who).tolist():
                held = np.unique(np.repeat(r, times)[who == i])
                enough = np.isin(codes[held], index["codes"][i]).sum(axis=1) >= index["shared"]
                out[i] += (at + held[enough]).tolist()
        return {i: at for i, at in out.items() if at}


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each low up to its high (exclusive), one after the other."""
    times = high - low
    return np.arange(times.sum()) + np.repeat(low - np.cumsum(times) + times, times)


def _run_codes(ids: np.ndarray, n: int, base: int) -> np.ndarray:
    if len(ids) < n:
        return np.zeros(0, np.int64)
    code = ids[: len(ids) - n + 1].copy()
    for i in range(1, n):
        code = code * base + ids[i: len(ids) - n + 1 + i]
    return code


def blocks(benchmark: DataFrame, size: int = BLOCK):
    """Distinct items in blocks of at most ``size``, by the hash of their row."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n = max(1, -(-items.count() // max(1, size * 9 // 10)))
    for b in range(n):
        yield sorted((tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()), key=str)


def annotate(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs with every column in a struct ``row``, and its hits."""
    hits = T.ArrayType(HIT)
    rows = docs.select(F.struct("*").alias("row"), F.array().cast(hits).alias("hits"))
    for k, items in enumerate(blocks(benchmark, block)):
        rows = _pass(stash(rows, "hits") if k else rows, items, hits)
    return rows


def _pass(rows: DataFrame, items: list[tuple], hits: T.ArrayType) -> DataFrame:
    sizes = {len(words(text or "")) for _, text in items} - {0}
    # built once; a worker process reads it once, whatever the number of its tasks
    shared = rows.sparkSession.sparkContext.broadcast(Index(items, plan={n: tables_for(n) for n in sizes}))
    schema = T.StructType([rows.schema["row"], T.StructField("hits", hits)])

    def make():
        index = shared.value
        number = Cache(lambda w: index.number.get(symbol(w), 0), 300_000)

        def run(batch):
            row = batch.column("row")
            held = (words(str(t or "")) for t in row.field("text").to_pylist())
            found = index.search([np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in held])
            before = batch.column("hits").to_pylist()
            return [row, [(x or []) + y for x, y in zip(before, found)]]
        return run

    return map_batches(rows, make, schema, rows=8192)  # windows of many texts are embedded together


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: contaminated, and its items with their windows."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return annotate(docs, read(spark, sf_dir, "benchmark")).select(
        "row.doc_id", (F.size("hits") > 0).alias("contaminated"), F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), "hits")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item stay."""
    return annotate(docs, read(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("row.*")
