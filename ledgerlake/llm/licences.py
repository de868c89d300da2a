"""Licence notices: a trained paragraph classifier, in DataFrame functions only.

A notice may stand in one line or be wrapped over several. Judged are the single
lines of a text, and from each line on its join with the next lines of the run of
non-blank lines it stands in, until these hold ``REACH`` words, more than any
template: a wrapped notice is whole in one join, and however long the run is, little
else is. Comment marks fall out of both. Of joins that overlap, the one that holds
most of a template of the family is reported, and none that holds a line confirmed
for that family. Features are the word unigrams and bigrams
of ``TEMPLATES`` that hold a word outside ``COMMON``: a bounded vocabulary. A
multinomial logistic regression over the licence families and the
class ``unknown`` is trained on the templates, parts of them, ``NEGATIVES`` and what is
judged of every document (a row of one id and text once) unless it holds a licence word:
its lines, and its joins of lines. These paragraphs are found once, written as their
features, and counted by distinct feature set; Spark's own logistic regression fits the
weights from the sets and their counts. The cut on
a family's probability is calibrated: of all paragraphs kept out of training (a quarter)
at most one unknown in a thousand reaches it. A prediction counts as confirmed if
the paragraph also holds ``CONTAINED`` of the features of a template of that
family.

A line without any word of the vocabulary has the intercepts alone, which is
``unknown``, and starts no join. n_paragraphs counts the lines with words. Scoring is one projection
of the written features: no shuffle, no join; every text is read whole.

Defined results: null and empty texts hold no paragraph and no licence;
repeated rows are judged row by row; an empty table gives no rows."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stash

UNKNOWN = "unknown"
CONTAINED, MISSED = 0.5, 0.001
REACH = 40
STEPS, RIDGE = 100, 1e-4

# Short notices by licence family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache 2.0 license."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL version 2 or later."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD license."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "This content is available under the CC BY-NC-SA 4.0 license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "This text is available under the Creative Commons Attribution-ShareAlike License.", "Licensed under CC BY-SA 4.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0.",
                      "SPDX-License-Identifier: CC0-1.0"],
    "reserved": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced without written permission."],
}
NEGATIVES = [
    "He lost his driver's license on the way to work.", "The apache helicopter landed near the village.", "Students at MIT built a new version of the machine.",
    "She has the right to vote and reserved a table.", "Version 2.0 of the program was released in May.", "The general public was not admitted.",
    "Free of charge, as always.", "The source of the river is not known.", "Public transport is free on Sundays.", "A copy of the letter is kept in the archive.",
    "Creative people need common sense.", "The foundation was laid in 1990.", "You may use the back door.", "This work is hard.", "Permission to land was granted.",
    "All seats are reserved.", "The mozilla was a dinosaur.", "The file is open.", "Terms and conditions were discussed.", "Use the form below.",
]
COMMON = ("a all and any are as at available be by following for form free general in into is it may no not of on or part person public released "
          "source terms that the this to under use with without work you version").split()


def plain(text: Column) -> Column:
    """Lower case; letters, digits, inner dots and hyphens, and line breaks stay."""
    return F.regexp_replace(F.lower(text), r"[.\-]+(?=[^\p{L}\p{N}]|$)|[^\p{L}\p{N}.\-\n]+", " ")


def line_words(line: Column) -> Column:
    return F.filter(F.split(line, "[ .]*[ ]+[ .]*|^[ .]+|[ .]+$"), lambda w: w != "")


def numbered(text: Column) -> Column:
    """All lines with their words."""
    return F.transform(F.split(plain(F.coalesce(text, F.lit(""))), "\n"), lambda line, i: F.struct(i.alias("line"), line_words(line).alias("words")))


def joined(p: Column, x: Column) -> Column:
    """Line x of the lines p with the next lines of its run (line, last, words); null if it has none."""
    def take(acc: Column, y: Column) -> Column:
        ws = F.when(F.get(y["words"], 0).isin("rem", "dnl"), F.slice(y["words"], 2, 1 << 30)).otherwise(y["words"])  # comment marks that are words
        held = acc["open"] & (F.size(ws) > 0) & (F.size(acc["words"]) < REACH)
        return F.when(held, F.struct(y["line"].alias("last"), F.concat(acc["words"], ws).alias("words"), F.lit(True).alias("open"))).otherwise(
            F.struct(acc["last"].alias("last"), acc["words"].alias("words"), F.lit(False).alias("open")))

    start = F.struct(x["line"].alias("last"), F.array().cast("array<string>").alias("words"), F.lit(True).alias("open"))
    return F.aggregate(F.slice(p, x["line"] + 2, REACH), start, take, lambda acc: F.when(F.size(acc["words"]) > 0, F.struct(  # a line has a word at least
        x["line"].alias("line"), acc["last"].alias("last"), F.concat(x["words"], acc["words"]).alias("words"))))


def grams(words: Column) -> Column:
    """Distinct word unigrams and bigrams."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1),
                                                  lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))
    return F.array_distinct(F.concat(words, F.coalesce(pairs, F.array().cast("array<string>"))))


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def _local(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Literal (text, family) rows."""
    return spark.range(1).select(F.inline(_literal([{"text": t, "family": f} for t, f in rows], "array<struct<text:string,family:string>>")))


def _halves(text: str) -> list[str]:
    ws = text.split()
    return [" ".join(ws[: len(ws) * 3 // 4])] if len(ws) > 6 else []


def _vocabulary(spark: SparkSession) -> dict[str, list]:
    """Features of every template, by family."""
    common = _strings(COMMON)
    useful = lambda g: F.exists(F.split(g, " "), lambda w: ~F.array_contains(common, w))
    rows = _local(spark, [(t, f) for f, ts in TEMPLATES.items() for t in ts])
    got = rows.select("family", F.filter(grams(line_words(plain(F.col("text")))), useful).alias("grams")).collect()  # of the templates
    return {f: [r["grams"] for r in got if r["family"] == f] for f in TEMPLATES}


def _singles(templates: dict[str, list]) -> list[str]:
    return sorted({g for ts in templates.values() for t in ts for g in t if " " not in g})


def paragraphs(docs: DataFrame, templates: dict[str, list]) -> DataFrame:
    """Of every document what is judged: n_paragraphs (lines with words), p (line, last,
    grams, free of licence words, held out of training) for lines and joins with a word of
    the vocabulary, and the number of the other lines, held out or not; h names id and text."""
    single = _strings(_singles(templates))
    known = _literal({g: 1 for ts in templates.values() for t in ts for g in t}, "map<string,int>")
    held = lambda ws: F.pmod(F.xxhash64(ws), F.lit(4)) == 0
    step1 = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), numbered(F.col("text")).alias("p"))
    alone = lambda x: F.struct(x["line"].alias("line"), x["line"].alias("last"), x["words"].alias("words"))
    has = lambda x: F.arrays_overlap(x["words"], single)
    pieces = F.transform(F.filter("p", has), lambda x: F.array(alone(x), joined(F.col("p"), x)))
    others = F.filter("p", lambda x: (F.size(x["words"]) > 0) & ~has(x))
    keeps = lambda k: lambda x: x == F.lit(k)
    step2 = step1.select("doc_id", "h", F.size(F.filter("p", lambda x: F.size(x["words"]) > 0)).cast("long").alias("n_paragraphs"), F.filter(F.flatten(pieces), lambda x: x.isNotNull()).alias("p"),
                         F.transform(others, lambda x: held(x["words"])).alias("bare"))
    return step2.select("doc_id", "h", "n_paragraphs", *[F.size(F.filter("bare", keeps(k))).cast("long").alias(c)
                                                         for c, k in (("bare_trained", False), ("bare_held", True))], F.transform("p", lambda p: F.struct(
        p["line"].alias("line"), p["last"].alias("last"), F.filter(grams(p["words"]), lambda g: F.map_contains_key(known, g)).alias("grams"),
        (~F.array_join(p["words"], " ").rlike("licen[sc]e|copyright|rights reserved|public domain|permission|spdx")).alias("free"), held(p["words"]).alias("held"))).alias("p"))


def train(docs: DataFrame, found: DataFrame | None = None) -> dict:
    """Vocabulary, weights, cut and template features; docs(doc_id, text), or what
    ``paragraphs`` found in them, give unknown paragraphs."""
    spark = docs.sparkSession
    templates = _vocabulary(spark)
    if found is None:
        found = stash(paragraphs(docs, templates), "licence-paragraphs")
    vocabulary = sorted({g for ts in templates.values() for t in ts for g in t})
    families, words = [UNKNOWN, *sorted(TEMPLATES)], _strings(vocabulary)
    own = _local(spark, [(t, f) for f, ts in TEMPLATES.items() for x in ts for t in (x, *_halves(x))] + [(t, UNKNOWN) for t in NEGATIVES for _ in range(10)])
    own = own.select(F.array_position(_strings(families), F.col("family")).cast("double").alias("y"), F.lit(False).alias("held"),
                     F.array_intersect(grams(line_words(plain(F.col("text")))), words).alias("grams"), F.lit(1).cast("long").alias("n"))
    each = found.dropDuplicates(["h"])  # a row of one id and text once
    empty = F.array().cast("array<string>")
    unknown = each.select(F.explode("p").alias("p")).where("p.free").select("p.held", "p.grams", F.lit(1).cast("long").alias("n"))
    bare = each.agg(F.array(F.struct(F.lit(False).alias("held"), empty.alias("grams"), F.coalesce(F.sum("bare_trained"), F.lit(0)).alias("n")),
                            F.struct(F.lit(True).alias("held"), empty.alias("grams"), F.coalesce(F.sum("bare_held"), F.lit(0)).alias("n"))).alias("b")).select(F.inline("b"))
    rows = own.withColumn("y", F.col("y") - 1).unionByName(unknown.unionByName(bare).withColumn("y", F.lit(0.0)))
    sets = stash(rows.withColumn("grams", F.array_sort("grams")).groupBy("y", "held", "grams").agg(F.sum("n").alias("n")).where("n > 0"), "licence-sets")
    vector = array_to_vector(F.transform(words, lambda g: F.array_contains("grams", g).cast("double")))
    sets = sets.withColumn("x", vector)
    taught = sets.where("not held")
    share = {r["y"]: r["n"] for r in taught.groupBy("y").agg(F.sum("n").alias("n")).collect()}  # a row a family
    of = F.element_at(F.array(*[F.lit(float(share[k])) for k in range(len(families))]), (F.col("y") + 1).cast("int"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", regParam=RIDGE, elasticNetParam=0.0, standardization=False,
                               maxIter=STEPS, tol=1e-7).fit(taught.withColumn("weight", F.col("n") / of))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(families) - 1))
    cut = model.transform(sets.where("held")).agg(F.percentile(best, F.lit(1 - MISSED), F.col("n"))).first()[0]
    weights = model.coefficientMatrix.toArray()
    return {"families": families, "weights": {g: weights[:, i].tolist() for i, g in enumerate(vocabulary)}, "intercept": model.interceptVector.toArray().tolist(),
            "cut": max(0.5, cut or 0.0), "templates": templates}


def scan(docs: DataFrame, model: dict, found: DataFrame | None = None) -> DataFrame:
    """doc_id, n_paragraphs and licences (line, family, probability, contained,
    confirmed) of docs(doc_id, text), or of what ``paragraphs`` found in them: every
    line whose family reaches the cut, and the confirmed joins from a line on."""
    families, k = model["families"], len(model["families"])
    weights = _literal(model["weights"], "map<string,array<double>>")
    templates = _literal(model["templates"], "map<string,array<array<string>>>")
    none = F.array(*[F.lit(0.0)] * k)
    step3 = paragraphs(docs, model["templates"]) if found is None else found
    margins = lambda gs: F.aggregate(gs, F.array(*map(F.lit, model["intercept"])),
                                     lambda acc, g: F.zip_with(acc, F.coalesce(F.element_at(weights, g), none), lambda x, y: x + y))
    step4 = step3.select("doc_id", "n_paragraphs", F.transform("p", lambda p: F.struct(
        p["line"].alias("line"), p["last"].alias("last"), p["grams"].alias("grams"), F.transform(margins(p["grams"]), lambda m: F.exp(F.least(m, F.lit(500.0)))).alias("e"))).alias("p"))
    names = _strings(families[1:])

    def judged(p: Column) -> Column:
        total = F.aggregate(p["e"], F.lit(0.0), lambda a, e: a + e)
        of = F.slice(p["e"], 2, k - 1)
        family = F.element_at(names, F.array_position(of, F.array_max(of)).cast("int"))
        shares = F.transform(F.element_at(templates, family), lambda t: F.size(F.array_intersect(t, p["grams"])) / F.size(t))
        contained = F.array_max(shares)
        return F.struct(p["line"].cast("long").alias("line"), p["last"].cast("long").alias("last"), family.alias("family"), (F.array_max(of) / total).alias("probability"),
                        contained.alias("contained"), (contained >= CONTAINED).alias("confirmed"))

    step5 = step4.select("doc_id", "n_paragraphs", F.filter(F.transform("p", judged), lambda x: x["probability"] >= model["cut"]).alias("found"))

    def reported(x: Column) -> Column:
        """A line, or a confirmed join that no confirmed line within and no better join over it stands for."""
        def better(y: Column) -> Column:
            same = y["confirmed"] & (y["family"] == x["family"])
            within = (y["line"] == y["last"]) & y["line"].between(x["line"], x["last"])
            over = (y["line"] < y["last"]) & (y["line"] < x["last"]) & (x["line"] < y["last"])
            first = (y["contained"] > x["contained"]) | ((y["contained"] == x["contained"]) & (y["line"] < x["line"]))
            return same & (within | (over & first))
        return (x["line"] == x["last"]) | (x["confirmed"] & ~F.exists("found", better))

    kept = F.transform(F.filter("found", reported), lambda x: x.dropFields("last"))
    return step5.select("doc_id", "n_paragraphs", kept.alias("licences"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = stash(paragraphs(docs, _vocabulary(spark)), "licence-paragraphs")  # found once, for training and scan
    found = scan(docs, train(docs, held), held)
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select("doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_licences"),
                        F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))).alias("families"), "licences")
