"""Language identification by the nearest of several centroids per language.

A text's vector holds hashed character n-grams (one to three lower-case
letters and word edges) as log term frequency times inverse document
frequency, of length one. Document frequencies count all training documents;
a language's centroids come from spherical k-means over a bounded sample
(about ``SAMPLE`` ids per language, by hash of the id, and one text an id however
often it is repeated; of the ``LANGUAGES`` with most ids). The language of
the centroid with the greatest cosine wins; a text whose cosine lies below
nearly all of that centroid's training texts is rejected (``accepted`` false).

Defined results: null texts and texts without a letter are ``und`` with score
0 and not accepted; of equal cosines the language first in order wins; texts are
read whole, however long; without any training row every text is ``und``; repeated
rows are judged row by row; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, is_fold, map_batches, read, ship

FOLDS, HELD_OUT = 4, 2
SIZE, SAMPLE, LANGUAGES, CENTROIDS, ROUNDS = 4096, 400, 1000, 3, 12
#: Share of a centroid's training texts that rejection may lose.
LOSS = 0.002


def _letters() -> np.ndarray:
    """Code point -> itself if a letter, else 0 (a word edge), as are all beyond the first plane."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(65536)] + [0], np.uint32)


def counts(text: str, letters: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    c = letters[np.minimum(np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32), 65536)]
    c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]  # one edge between words
    if len(c) < 3:
        return np.zeros(SIZE, np.int64)
    one = c.astype(np.uint64)
    two = one[:-1] * np.uint64(65599) + one[1:]
    three = two[:-1] * np.uint64(65599) + one[2:]
    three = three[c[1:-1] > 0]  # the middle is a letter
    grams = np.concatenate([one[c > 0] + np.uint64(1 << 60), two + np.uint64(1 << 61), three])
    return np.bincount(((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=SIZE)


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).astype(np.float32)


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each hashed n-gram, and documents, over all of docs(text)."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        letters, df, rows = _letters(), np.zeros(SIZE + 1, np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                df[:SIZE] += counts(t or "", letters) > 0
                rows += 1
        df[SIZE] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1, dtype=np.int32)), pa.array(df)], ["feature", "n"])

    table = docs.select("text").mapInArrow(run, schema).groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SIZE + 1, np.int64)
    df[table["feature"].to_numpy()] = table["n"].to_numpy()
    return df[:SIZE], int(df[SIZE])


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows by cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def train(docs: DataFrame) -> dict | None:
    """Model from docs(doc_id, text, lang), outside the held-out fold and with a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).where("text is not null")
    per = (rows.groupBy("lang", "doc_id").count().groupBy("lang").agg(F.count("*").alias("count"))
           .orderBy(F.desc("count"), "lang").limit(LANGUAGES).toPandas())
    if not len(per):
        return None
    df, total = _frequencies(rows)
    idf = np.log((total + 1) / (df + 1)) + 1
    share = F.create_map(*[F.lit(v) for lang, n in zip(per["lang"], per["count"]) for v in (lang, min(1.0, SAMPLE / n))])
    sample = (rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
              .groupBy("lang", "doc_id").agg(F.min("text").alias("text")))  # collapses within each task
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("v", T.BinaryType())])

    def make():
        letters = _letters()
        return lambda batch: [batch.column("doc_id"), batch.column("lang"),
                              [vector(counts(t, letters), idf).tobytes() for t in batch.column("text").to_pylist()]]

    table = map_batches(sample.select("doc_id", "lang", "text"), make, schema).toPandas()
    table = table[table["v"].map(lambda v: np.frombuffer(v, np.float32).any())]
    if not len(table):
        return None
    langs, centres, least = [], [], []
    for lang, group in sorted(table.groupby("lang"), key=lambda x: x[0]):
        x = np.stack([np.frombuffer(v, np.float32) for _, v in sorted(zip(group["doc_id"], group["v"]))])
        c = kmeans(x, CENTROIDS)
        sim = x @ c.T
        for j in range(len(c)):
            own = sim[sim.argmax(axis=1) == j, j]
            langs.append(lang)
            centres.append(c[j])
            least.append(float(np.quantile(own, LOSS)) if len(own) else 1.0)
    return {"idf": idf, "langs": langs, "centres": np.stack(centres), "least": np.array(least)}


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted for docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, letters = shared.value, _letters()

        def run(batch):
            lang, score, accepted = [], [], []
            for t in batch.column("text").to_pylist():
                if m is None or not any(map(str.isalpha, t or "")):
                    lang.append("und"), score.append(0.0), accepted.append(False)
                    continue
                sim = m["centres"] @ vector(counts(t, letters), m["idf"])
                j = int(sim.argmax())
                lang.append(m["langs"][j]), score.append(min(1.0, max(0.0, float(sim[j])))), accepted.append(bool(sim[j] >= m["least"][j]))
            return [batch.column("doc_id"), lang, score, accepted]
        return run

    return map_batches(docs.select("doc_id", "text"), make, T.StructType([T.StructField("doc_id", T.LongType()), *PREDICTED]))


def op3_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = predict(docs, train(docs))
    return found.select("doc_id", is_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "accepted")
