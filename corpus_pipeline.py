"""A training-data pipeline over ``documents``: drop toxic texts, drop exact
copies, keep one document of each group of near copies, mix the sources to
their target weights and pack the result into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet to the shared folder and rereads it as the next stage's
``docs``. All but the last return the columns of ``docs``.

NULL text counts as empty throughout: it scores as a text without evidence,
all empty texts are exact copies of each other, an empty text is nobody's near
copy, is taken 0 words by the mix and packs as one end id. An empty table
passes through every stage. Extra columns are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from podium.llm import best_fit, block_naming, noisy_channel, order_join, systematic_mix
from podium.llm.common import written

NEAR_WORDS = 5
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold, by a model
    fitted on the labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return noisy_channel.without_toxic(docs, noisy_channel.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return block_naming.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard index of 0.8 or more over five-word
    shingles, the one with the smallest doc_id."""
    return order_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return systematic_mix.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    return best_fit.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # a fitted model, similarity components and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
