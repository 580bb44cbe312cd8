"""Corpus pipeline: language ID, near-dedup, personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's result as Parquet
into the session's shared folder and hands the reread table to the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import langid, mixing, packing, pii, simhash
from quarry.llm.common import lean
from quarry.sources.tables import shared_folder

#: Words that a worker remembers in a stage: workers outlive stages, so their caches add up.
CACHE = 100_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    lean(spark)
    return langid.keep_known(docs, cache_words=CACHE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    lean(spark)
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found spans replaced by their kind."""
    lean(spark)
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a part of a document counts as once from half of it on."""
    lean(spark)
    return mixing.resample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    lean(spark)
    return packing.pack(docs, cache_words=CACHE)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language models, components and token ids are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
