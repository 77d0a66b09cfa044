"""The corpus pipeline: four stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows that stay, with
the columns of ``documents``; the last returns packed pieces. ``run`` writes
each stage's rows as Parquet in the shared folder and reads them as the next
one's input.

Cases, of every stage: rows of null ids, repeated rows and columns of other names
(whatever they are called) are treated like any other and keep all their values; an empty
table gives an empty one. Null and empty texts are not toxic, in no language, so the second stage
drops them; should one reach the later stages, it is a near copy of the other empty ones, and packed as its end token alone.
Without labels of both kinds nothing is toxic; without any ``lang`` to learn from no
document is in a language. Of near copies the smallest id stays, of rows of one id and text one; texts are
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repeatlake.llm import language, packing, simhash, toxicity
from repeatlake.plans.storage import materialize

#: No SQL: classifiers and tokenizers decide which rows stay.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from ``labels``, is under 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are told to be in one of the languages learned from their ``lang``."""
    return language.with_language(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return simhash.without_near_copies(docs, width=5, similarity=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the documents that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
