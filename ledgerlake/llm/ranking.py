"""Document quality by Bradley-Terry ranking of preference pairs.

A document has a strength s = w.x over counts of its whole text; a pair
(preferred, other) is won with probability sigmoid(s_a - s_b), so the
logistic loss is one on feature differences. The pairs are all pairs of a
document labelled 1 with one labelled 0. The cut is a quantile of the training
strengths: the share of label 0. score = sigmoid(s - cut).

Every labelled document outside the held-out fold trains, an id once. Its
features are counted once and written; a Newton step is one job over them. The
loss depends on a pair through the two strengths alone, so tasks add up the
moments of the features by label and bin of strength (``BINS``, at most
2 x ``BINS`` rows a task), and the driver adds the pairs of bins, linear about
the bins' own means. The cut is the exact order statistic.

Defined results: null and empty texts are scored like any text; null labels
and null ids don't train; without both labels every score is 0.5; an empty
table gives no rows; repeated rows are scored row by row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, is_fold, map_batches, read, stash, texts
from .textstats import stats

FOLDS, HELD_OUT = 3, 1
STEPS, RIDGE = 25, 1e-3
#: Bins of strength of a label, from -REACH to REACH (what lies beyond falls into the outer ones).
BINS, REACH = 1024, 32.0


SPACE, LETTER, CAPITAL, DIGIT, STOP, ODD = 1, 2, 4, 8, 16, 32


def _kinds() -> np.ndarray:
    """Kind of every code point of the first plane; those beyond count as odd."""
    kind = np.full(65537, ODD, np.uint8)
    for i in range(65536):
        c = chr(i)
        kind[i] = (SPACE if c in " \t\n\v\f\r" else LETTER | CAPITAL * c.isupper() if c.isalpha() else DIGIT if c.isdigit()
                   else STOP if c in ".!?" else 0 if c in ",;:'\"-()" else ODD)
    return kind


def features(text: str, kinds: np.ndarray) -> np.ndarray:
    """Rates of a whole text, all within about 0..3."""
    x = stats(text)
    ids, n = x["ids"], x["n_words"]
    if not n:
        return np.zeros(15)
    kind = kinds[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 65536)]
    word = kind != SPACE
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))  # start, end, start, end, ...
    start, end = edge[::2], edge[1::2]
    per_word = [np.add.reduceat((kind & bit) != 0, start, dtype=np.int64) for bit in (LETTER, CAPITAL)]  # spaces add nothing
    letters, caps = per_word[0].sum(), per_word[1].sum()
    loud = ((per_word[0] == per_word[1]) & (per_word[0] > 1)).sum()
    lone = ((per_word[0] == 0) & (end - start < 3)).sum()
    stop, odd, digits = (kind[end - 1] == STOP).sum(), (kind == ODD).sum(), (kind == DIGIT).sum()
    count, chars, lines = np.bincount(ids), x["word_chars"], text.split("\n")
    return np.array([
        np.log10(n + 1), letters / chars, caps / max(1, letters), digits / chars, loud / n, stop / n, odd / n, lone / n,
        x["n_symbols"] / n, x["n_dup_lines"] / len(lines), x["n_repeat_words"] / n, 1 - len(count) / n,
        count.max() / n, float((ids[1:] == ids[:-1]).sum()) / n, chars / n / 10])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def bradley_terry(win: np.ndarray, lose: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the logistic loss of win - lose (Newton steps)."""
    diff, w = win - lose, np.zeros(win.shape[1])
    for _ in range(steps):
        p = _sigmoid(diff @ w)
        grad = diff.T @ (p - 1) / len(diff) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


FEATURES = 15
_UPPER = np.triu_indices(FEATURES)
MOMENTS = 1 + FEATURES + len(_UPPER[0])  # number, sums, sums of products


def moments(table: DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Per label (0, 1) and bin of strength that holds rows: label, and the rows' number,
    feature sums and sums of products, over all of table(quality, x)."""
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def make():
        sums = {}

        def run(batch):
            z = (np.stack(batch.column("x").to_numpy(zero_copy_only=False)) - model["mean"]) / model["scale"]
            at = np.clip(np.floor((z @ model["w"] + REACH) * (BINS / 2 / REACH)), 0, BINS - 1).astype(np.int64)
            cell, of = np.unique(batch.column("quality").to_numpy() * BINS + at, return_inverse=True)
            order = np.argsort(of, kind="stable")
            each = np.concatenate([np.ones((len(z), 1)), z, z[:, _UPPER[0]] * z[:, _UPPER[1]]], axis=1)[order]
            for c, row in zip(cell.tolist(), np.add.reduceat(each, np.searchsorted(of[order], np.arange(len(cell))))):
                sums[c] = sums[c] + row if c in sums else row
            return [[], []]

        run.finish = lambda: [list(sums), list(sums.values())] if sums else None
        return run

    total = F.aggregate(F.collect_list("m"), F.array_repeat(F.lit(0.0), MOMENTS), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))  # one a task
    got = map_batches(table.select("quality", "x"), make, schema, 8192).groupBy("cell").agg(total.alias("m")).collect()  # at most 2 x BINS rows
    got.sort(key=lambda r: r["cell"])
    return np.array([r["cell"] >= BINS for r in got]), np.array([r["m"] for r in got])


def newton(label: np.ndarray, rows: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The Newton step of the mean loss over all pairs of a row labelled 1 with one labelled 0, from their moments."""
    def parts(x):
        square = np.zeros((len(x), len(w), len(w)))
        square[:, _UPPER[0], _UPPER[1]] = square[:, _UPPER[1], _UPPER[0]] = x[:, FEATURES + 1:]
        return x[:, 0], x[:, 1:FEATURES + 1], square

    (n, x, xx), (m, y, yy) = parts(rows[label]), parts(rows[~label])
    s, t = x @ w / n, y @ w / m
    p = _sigmoid(s[:, None] - t)
    lost, h, pairs = p - 1, p * (1 - p), n.sum() * m.sum()
    within = (h @ m) @ (xx @ w - s[:, None] * x) + (n @ h) @ (yy @ w - t[:, None] * y)  # strengths differ within a bin
    grad = ((lost @ m) @ x - (n @ lost) @ y + within) / pairs + ridge * w
    cross = x.T @ h @ y
    hess = (np.tensordot(h @ m, xx, 1) + np.tensordot(n @ h, yy, 1) - cross - cross.T) / pairs + ridge * np.eye(len(w))
    return np.linalg.solve(hess, grad)


def fit(table: DataFrame, share: float) -> dict:
    """Model from all rows of a written table(quality, x) and the share of label 0."""
    size, col = FEATURES, lambda i: F.col("x")[i]
    one = table.agg(*[F.avg(col(i)) for i in range(size)], *[F.stddev_pop(col(i)) for i in range(size)]).first()
    model = {"mean": np.array(one[:size]), "scale": np.array(one[size:]) + 1e-6, "w": np.zeros(size)}
    for _ in range(STEPS):
        step = newton(*moments(table, model), model["w"])
        model["w"] = model["w"] - step
        if np.abs(step).max() < 1e-6:
            break
    return model | {"cut": quantile(strengths(table, model), share)}


def strengths(table: DataFrame, model: dict) -> DataFrame:
    """The strength of every row, as the whole number ``key`` in the same order."""
    def make():
        def run(batch):
            s = (np.stack(batch.column("x").to_numpy(zero_copy_only=False)) - model["mean"]) / model["scale"] @ model["w"] + 0.0  # no -0
            bits = s.view(np.int64)
            return [bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))]
        return run

    return stash(map_batches(table.select("x"), make, T.StructType([T.StructField("key", T.LongType())])), "strengths")


def quantile(keys: DataFrame, share: float) -> float:
    """The quantile of all strengths (the middle of the two next to it)."""
    at = share * (keys.count() - 1)
    bits = np.array([ranked(keys, int(np.floor(at))), ranked(keys, int(np.ceil(at)))])
    return float((bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))).view(np.float64).mean())


def ranked(keys: DataFrame, rank: int) -> int:
    """The key with ``rank`` keys before it, by 16 bits at a time: each job counts at most 65,536 groups."""
    found = 0
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key", shift)
        held = keys if shift == 48 else keys.where(F.shiftright("key", shift + 16) == found)
        for value, n in sorted(held.groupBy(part.alias("p")).count().collect()):
            if rank < n:
                break
            rank -= n
        found = value
    return found


def train(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> dict | None:
    """Bradley-Terry model from all labelled documents outside the held-out fold
    (``rows``, for trials only: at most so many, least hash of the id first)."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where("doc_id is not null and quality in (0, 1)").where(crc_mod("doc_id", FOLDS) != HELD_OUT))
    total, zeros = marked.agg(F.count("*"), F.sum((F.col("quality") == 0).cast("long"))).first()
    if not total or not 0 < zeros < total:
        return None
    one = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if rows is not None:
        one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # features before the join: they are moved, not the texts
    texts_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    table = stash(_featured(texts_).join(one, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")), "features")  # an id counts once
    if table.agg(F.countDistinct("quality")).first()[0] < 2:
        return None
    return fit(table, zeros / total)


def _featured(docs: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def make():
        kinds = _kinds()
        return lambda batch: [batch.column("doc_id"), [features(t, kinds) for t in texts(batch)]]

    return map_batches(docs.select("doc_id", "text"), make, schema)


def score(docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """docs with every column in a struct ``row``, and the score of its text."""
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField(column, T.DoubleType())])

    def make():
        kinds = _kinds()

        def run(batch):
            row = batch.column("row")
            ts = [str(t or "") for t in row.field("text").to_pylist()]
            if model is None:
                return [row, np.full(len(ts), 0.5)]
            x = np.stack([features(t, kinds) for t in ts])
            return [row, _sigmoid((x - model["mean"]) / model["scale"] @ model["w"] - model["cut"])]
        return run

    return map_batches(rows, make, schema)


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", is_fold("row.doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.5 stay."""
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.where("score >= 0.5").select("row.*")
