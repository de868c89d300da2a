"""The corpus pipeline: documents -> packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import bagminhash, cgk, packing, pii, ranking
from ledgerlake.llm.common import read, stash

STAGES = [
    ("quality classifier", ranking.stage),
    ("near-duplicates", bagminhash.stage),
    ("benchmark decontamination", cgk.stage),
    ("personal data", pii.stage),
    ("best-fit packing", packing.stage),
]

#: Trained models and tokenizers decide the rows: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
