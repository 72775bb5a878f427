"""A training corpus from raw documents.

Each stage takes the documents table its predecessor left, applies one operator to all of
it, and leaves a documents table; the last one returns the packed pieces. ``run`` writes every
stage's table to the cluster's shared folder and reads it back, so a lost executor repeats
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strikeloom.llm import mixing, neardup, packing, pii, toxicity
from strikeloom.llm.common import read, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.5 or more."""
    docs = docs.select(COLUMNS)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where("score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of every class of near-duplicates."""
    return neardup.keep_one(docs.select(COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; ``n_chars`` follows."""
    docs = docs.select(COLUMNS)
    model = pii.train(pii.weak_labels(docs))
    return pii.find_and_mask(docs, model, keep=COLUMNS).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents or leaves them out so that the sources come near their target weights."""
    return mixing.emit(mixing.mix_sources(docs.select(COLUMNS)), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models and dynamic programmes: SQL does not express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
