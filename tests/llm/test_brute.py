"""Whole results of op3, op5, op8 and the pipeline against plain brute force over sf0.001."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlake.llm import centroids, cgk, licences, packing, pii, ranking
from ledgerlake.llm.common import read

SF1 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF1}/documents.parquet'").fetchall())


def crc(doc):
    return zlib.crc32(str(doc).encode())


# ---- op3 -------------------------------------------------------------------------

def gram_counts(text):
    """Counts of hashed letters, pairs and triples, symbol by symbol."""
    cs = []
    for c in f" {text.lower()} ":
        x = ord(c) if c.isalpha() and ord(c) < 65536 else 0
        if x or not cs or cs[-1]:
            cs.append(x)
    out = Counter()
    for i, c in enumerate(cs):
        found = [c + (1 << 60)] if c else []
        if i:
            found.append(cs[i - 1] * 65599 + c + (1 << 61))
        if i > 1 and cs[i - 1]:
            found.append((cs[i - 2] * 65599 + cs[i - 1]) * 65599 + c)
        out.update((g * 0x9E3779B97F4A7C15 % (1 << 64)) >> 52 for g in found)
    return out if len(cs) > 2 else Counter()


def test_op3_whole_table(spark, texts):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF1}/documents.parquet'").fetchall())
    docs = read(spark, SF1, "documents").select("doc_id", "text", "lang")
    model = centroids.train(docs)
    trained = [d for d in texts if langs[d] is not None and crc(d) % 4 != 2]
    seen = Counter(g for d in trained for g in gram_counts(texts[d]))
    idf = np.array([np.log((len(trained) + 1) / (seen[g] + 1)) + 1 for g in range(centroids.SIZE)])
    assert np.allclose(idf, model["idf"])
    got = {r.doc_id: r for r in centroids.predict(docs, model).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        if not any(c.isalpha() for c in text):
            assert got[d].lang_pred == "und" and got[d].score == 0
            continue
        v = np.zeros(centroids.SIZE)
        for g, n in gram_counts(text).items():
            v[g] = np.log1p(n) * idf[g]
        cosine = [float(v @ c) / (np.linalg.norm(v) or 1) for c in model["centres"]]
        assert got[d].score == pytest.approx(max(0, max(cosine)), abs=1e-5)
        assert cosine[model["langs"].index(got[d].lang_pred)] <= max(cosine) and max(
            x for x, lang in zip(cosine, model["langs"]) if lang == got[d].lang_pred) == pytest.approx(max(cosine), abs=1e-5)


def test_op3_a_repeated_id_trains_once(spark):
    rows = [(i, f"the wide river runs to the sea {i}", "en") for i in range(0, 60)] + [(i, f"der breite fluss geht zum meer {i}", "de") for i in range(60, 120)]
    hot = [rows[0]] * 5000
    schema = "doc_id long, text string, lang string"
    one, many = (centroids.train(spark.createDataFrame(x, schema)) for x in (rows, rows + hot))
    assert one["langs"] == many["langs"] and one["centres"].shape == many["centres"].shape
    probe = spark.createDataFrame([(1, "the sea"), (2, "das meer der fluss")], "doc_id long, text string")
    for model in (one, many):
        assert [r.lang_pred for r in centroids.predict(probe, model).orderBy("doc_id").collect()] == ["en", "de"]


def test_op3_keeps_the_languages_with_most_ids(spark, monkeypatch):
    monkeypatch.setattr(centroids, "LANGUAGES", 2)
    rows = [(i, "abc def", "x" if i < 20 else "y" if i < 35 else f"dirty{i}") for i in range(60)]
    assert set(centroids.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["langs"]) == {"x", "y"}


# ---- op5 -------------------------------------------------------------------------

def test_op5_weights_by_gradient_descent():
    rng = np.random.default_rng(3)
    win, lose = rng.normal(0.4, 1, (3000, 5)), rng.normal(0, 1, (3000, 5))
    diff, w = win - lose, np.zeros(5)
    for _ in range(4000):
        w -= 0.2 * (-(diff.T @ (1 / (1 + np.exp(diff @ w)))) / len(diff) + 0.001 * w)
    assert np.allclose(w, ranking.bradley_terry(win, lose, ridge=0.001), atol=1e-4)


def test_op5_whole_table(spark, texts):
    docs = read(spark, SF1, "documents").select("doc_id", "text")
    model, kinds = ranking.train(docs, read(spark, SF1, "labels")), ranking._kinds()
    got = {r["row"]["doc_id"]: r["score"] for r in ranking.score(docs, model).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        z = sum(w * (x - m) / s for w, x, m, s in zip(model["w"], ranking.features(text, kinds), model["mean"], model["scale"])) - model["cut"]
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_op5_all_pairs_and_exact_cut(spark):
    """Every labelled document trains: the weights are those of all pairs, the cut is the quantile of all strengths."""
    rng = np.random.default_rng(8)
    y = (rng.random(300) < 0.6).astype(int)
    x = rng.normal(0, 1, (300, ranking.FEATURES)) + 0.4 * y[:, None]
    table = spark.createDataFrame([(int(q), v.tolist()) for q, v in zip(y, x)], "quality int, x array<double>").repartition(5)
    model = ranking.fit(table, 0.37)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    win, lose = (v.reshape(-1, ranking.FEATURES) for v in np.broadcast_arrays(z[y == 1][:, None], z[y == 0][None]))
    assert np.allclose(model["w"], ranking.bradley_terry(win, lose), atol=2e-4)
    assert model["cut"] == pytest.approx(np.quantile(z @ model["w"], 0.37, method="midpoint"), abs=1e-9)


def test_op5_learns_from_every_labelled_document(spark):
    """One more labelled document, whichever it is, changes the features' means."""
    ids = [i for i in range(1, 90) if zlib.crc32(str(i).encode()) % ranking.FOLDS != ranking.HELD_OUT]
    texts = {i: f"The river {i} runs on." if i % 2 else f"BUY {i} now !!! $$$" for i in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model, kinds = ranking.train(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")), ranking._kinds()
    assert np.allclose(model["mean"], np.mean([ranking.features(t, kinds) for t in texts.values()], axis=0))
    assert not hasattr(ranking, "TRAIN_ROWS")


# ---- op8 -------------------------------------------------------------------------

def brute_licences(text, model):
    plain = regex.sub(r"[.\-]+(?=[^\p{L}\p{N}]|$)|[^\p{L}\p{N}.\-\n]+", " ", text.lower())
    lines = [[w for w in regex.split(r"[ .]*[ ]+[ .]*|^[ .]+|[ .]+$", x) if w] for x in plain.split("\n")]
    pieces = []
    for i, ws in enumerate(lines):
        if not any(w in model["weights"] for w in ws):
            continue
        pieces.append((i, i, ws))
        more, last = [], i
        for j in range(i + 1, min(len(lines), i + 1 + licences.REACH)):
            if not lines[j] or len(more) >= licences.REACH:
                break
            own = lines[j][1:] if lines[j][0] in ("rem", "dnl") else lines[j]
            if not own:
                break
            more, last = more + own, j
        if more:
            pieces.append((i, last, ws + more))
    found = []
    for first, last, ws in pieces:
        grams = {g for g in [*ws, *map(" ".join, zip(ws, ws[1:]))] if g in model["weights"]}
        z = np.array(model["intercept"]) + sum((np.array(model["weights"][g]) for g in grams), np.zeros(len(model["intercept"])))
        p = np.exp(z) / np.exp(z).sum()
        best = int(p[1:].argmax()) + 1
        family = model["families"][best]
        contained = max(len(grams & set(t)) / len(t) for t in model["templates"][family])
        if p[best] >= model["cut"]:
            found.append((first, last, family, float(p[best]), contained))
    sure = [x for x in found if x[4] >= licences.CONTAINED]
    out = []
    for x in found:
        if x[0] < x[1]:
            beaten = any(y[2] == x[2] and (
                y[0] == y[1] and x[0] <= y[0] <= x[1]
                or y[0] < y[1] and y[0] < x[1] and x[0] < y[1] and (-y[4], y[0]) < (-x[4], x[0])) for y in sure)
            if x not in sure or beaten:
                continue
        out.append((x[0], x[2], round(x[3], 6), x in sure))
    return sum(bool(x) for x in lines), out


def test_op8_whole_table(spark, texts):
    docs = read(spark, SF1, "documents").select("doc_id", "text")
    model, n = licences.train(docs), 0
    for r in licences.scan(docs, model).collect():
        want = brute_licences(texts[r["doc_id"]], model)
        got = [(x["line"], x["family"], round(x["probability"], 6), x["confirmed"]) for x in r["licences"]]
        assert (r["n_paragraphs"], sorted(got)) == (want[0], sorted(want[1]))
        n += len(got)
    assert n


def test_op8_copies_take_no_more_than_a_row(spark):
    """A third of the rows alike: the sample still holds the others, and training is as without them."""
    rows = [(i, f"The river number {i} runs to the sea.\nIt is wide.") for i in range(300)]
    one, many = (licences.train(spark.createDataFrame(x, "doc_id long, text string")) for x in (rows, rows + rows[:1] * 150))
    assert one["cut"] == many["cut"] and one["weights"] == many["weights"]


def test_op8_learns_from_every_document(spark):
    """4,000 documents, beyond any former sample: each one's lines are counted, so the last rows change the weights."""
    rows = [(i, f"The river number {i} runs to the sea.") for i in range(4000)]
    odd = [(5000 + i, f"The apache copy of the software file {i}.") for i in range(400)]
    one, many = (licences.train(spark.createDataFrame(x, "doc_id long, text string")) for x in (rows, rows + odd))
    assert many["weights"]["apache"][0] > one["weights"]["apache"][0] + 0.1
    assert not hasattr(licences, "SAMPLE") and not hasattr(licences, "LINES")


# ---- pipeline --------------------------------------------------------------------

def near_classes(texts):
    """doc_id -> least id of its class: all pairs of texts with 0.8 or more of their five-word multisets in common."""
    bags, holders = {}, defaultdict(set)
    for d, t in texts.items():
        ws = t.encode().split()
        n = min(5, len(ws))
        bags[d] = Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)) if ws else Counter()
        for s in bags[d]:
            holders[s].add(d)
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sorted(texts):
        for b in {x for s in bags[a] for x in holders[s] if x > a}:
            both = (bags[a] & bags[b]).total()
            if both >= 0.8 * (bags[a].total() + bags[b].total() - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in texts}


def holds(item, text):
    a, b = ([cgk.symbol(w) for w in t.encode().split()] for t in (item, text))
    number = {w: i for i, w in enumerate({*a, *b})}
    a, b = np.array([number[w] for w in a]), np.array([number[w] for w in b], dtype=int)
    if not len(a) or not set(a) & set(b):
        return False
    rows = np.array([np.append(b[i:i + len(a)], np.full(max(0, len(a) - len(b)), -1)) for i in range(max(1, len(b) - len(a) + 1))])
    return cgk.distances(a, rows, np.full(len(rows), min(len(a), len(b)))).min() <= len(a) // 5


def test_pipeline_whole_table(spark, texts):
    docs = read(spark, SF1, "documents")
    model, kinds = ranking.train(docs.select("doc_id", "text"), read(spark, SF1, "labels")), ranking._kinds()
    kept = {d: t for d, t in texts.items() if (ranking.features(t, kinds) - model["mean"]) / model["scale"] @ model["w"] >= model["cut"]}
    assert 0.5 * len(texts) < len(kept) < len(texts)
    least = near_classes(kept)
    one = {d: t for d, t in kept.items() if least[d] == d or not t.split()}
    assert len(one) < len(kept)
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF1}/benchmark.parquet'").fetchall()]
    clean = {d: t for d, t in one.items() if not any(holds(i, t) for i in items)}
    assert len(clean) < len(one)
    crf = pii.model()
    spans = dict(zip(clean, (s for _, s in pii.all_spans(list(clean.values()), crf, crf.word_scores()))))
    encode = Tokenizer.from_file(packing.default_path()).encode
    want = {}
    for d, t in clean.items():
        for kind, start, end in sorted(spans[d], key=lambda x: -x[1]):
            t = t[:start] + f"<{kind}>" + t[end:]
        ids = np.array([*encode(t, add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[d, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = corpus_pipeline.run(spark, SF1).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    for seq in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
