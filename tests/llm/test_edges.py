"""Every operator and stage on nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from ledgerlake.llm import bagminhash, centroids, cgk, licences, lines, lm, packing, pii, ranking, registry

PROSE = "The quiet river bends around the old stone mill and carries its leaves to the sea. " * 12
JUNK = "buy### now$$$ the%%% best&&& deal*** ever### " * 20
ROWS = [
    (1, PROSE, "en", "a", 1, "x"), (2, PROSE, "en", "a", 1, "y"), (3, PROSE + "One more line.", "en", "b", 1, "z"),
    (4, None, "en", None, None, None), (5, "", None, "a", 0, None), (6, " \t\n ", "en", "a", 4, None), (7, "one", "en", "a", 3, None),
    (8, JUNK, "en", "b", 1, "x"), (9, "mail ann.b@example.org or +1 (202) 555-0143 at 10.0.0.1", "en", "b", 1, "x"),
    (None, "a row without an id, yet with words enough to be read", None, None, None, None), (10, "x" * 200_000, "en", "b", 1, "x"),
    (11, "Licensed under the Apache License, Version 2.0.\n" + PROSE, "en", "b", 1, "x"), (1, PROSE, "en", "a", 1, "x"),
    (12, "Der Fluss fließt über die alte Mühle und trägt das Laub zum Meer. " * 9, "de", "b", 1, "x"), (13, "日本語 😀 ½", "en", "b", 1, "x"),
    (15, " ".join(f"plain{i}" for i in range(60)) + ".", "en", "b", 1, "x"),
    (14, ("word%d " * 30) % tuple(range(30)) * 900, "en", "b", 1, "x"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType())])
BENCHMARK = [(1, "the old stone mill and carries its leaves to the sea the quiet river"), (2, None), (3, ""), (4, "one")]
LABELS = [(i, i % 4 != 0, 0) for i in range(1, 16)] + [(None, 1, 0), (8, None, None)]


@pytest.fixture(scope="module", params=["rows", "empty"])
def folder(request, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp(request.param))
    full = request.param == "rows"
    spark.createDataFrame(ROWS if full else [], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCHMARK if full else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(a, None if b is None else int(b), c) for a, b, c in LABELS] if full else [],
                          "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, full


#: The other two read pages and conversations, and are tested with their own edge rows.
OF_DOCUMENTS = sorted(set(registry.queries()) - {"op12_recurrent_html", "op13_conversation_repair"})


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_query(spark, folder, name):
    d, full = folder
    rows = registry.queries()[name](spark, d).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    want = sorted((r[0] is None, r[0] or 0) for r in ROWS) if full else []
    assert sorted(set(ids)) == sorted(set(want))
    if not name.startswith("op7"):  # pieces
        assert ids == want
    by = {r["doc_id"]: r for r in rows}
    if not full:
        return
    if name.startswith("op1_"):
        assert by[4]["n_tokens"] == by[5]["n_tokens"] == 0
    if name.startswith("op2_"):
        assert by[4]["base_failed"] and not by[4]["kept"] and by[1]["n_words"] == 192 and by[15]["kept"] and not by[8]["kept"]
    if name.startswith("op3_"):
        assert by[4]["lang_pred"] == by[5]["lang_pred"] == "und" and by[4]["score"] == 0.0
    if name.startswith("op4_"):
        assert (by[9]["n_email"], by[9]["n_ip"], by[9]["n_phone"], by[4]["spans"]) == (1, 1, 1, "")
    if name.startswith("op5_"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    if name.startswith("op6_"):
        assert by[1]["class_id"] == by[2]["class_id"] == by[3]["class_id"] == 1
        assert [by[i]["class_id"] for i in (4, 5, 6, 7)] == [4, 5, 6, 7]
    if name.startswith("op8_"):
        assert by[11]["families"] == ["apache-2.0"] and by[4]["n_licences"] == 0 and by[1]["n_licences"] == 0
    if name.startswith("op9_"):
        assert 1 in by[1]["item_ids"] and 4 in by[7]["item_ids"] and not by[4]["contaminated"] and not by[12]["contaminated"]
    if name.startswith("op11_"):
        assert len({r["root"] for r in rows}) == 1 and all(r["verified"] or "\n" in dict((x[0], x[1]) for x in ROWS)[r["doc_id"]] for r in rows)
    if name.startswith("op10_"):
        assert by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[14]["n_tokens"] == 27001


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, folder, name, stage):
    d, full = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = stage(spark, docs, d)
    if name != "best-fit packing":
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == T.LongType()
    rows = out.collect()
    if not full:
        assert rows == []
        return
    ids = {r["doc_id"] for r in rows}
    if name == "near-duplicates":
        assert {1, 4, 5, 6, 7, None} <= ids and not {2, 3} & ids and sum(r["doc_id"] == 1 for r in rows) == 1
    if name == "benchmark decontamination":
        assert 1 not in ids and 7 not in ids and {4, 5, 12, None} <= ids and all(r["score"] == "x" for r in rows if r["doc_id"] == 12)
    if name == "personal data":
        text = {r["doc_id"]: r["text"] for r in rows}
        assert text[9] == "mail <email> or <phone> at <ip>" and text[4] is None and text[1] == PROSE
        assert len(rows) == len(ROWS)


def test_run(spark, folder):
    d, full = folder
    rows = corpus_pipeline.run(spark, d).collect()
    assert bool(rows) == full
