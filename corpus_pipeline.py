"""A training corpus in five stages, from raw documents to packed sequences.

Each stage keeps the columns of documents (the last gives pieces) and treats
cases like its operator: null and empty texts are texts without words, which stay
and are packed as an end id; very long texts are read whole; rows with one id or
none are rows of their own; of linked rows with one id the first read stays; an
empty table gives no rows; further columns pass through whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, jaccard, packing, pii, queries, toxicity
from ledgerloom.llm.scratch import free_name, materialize

#: Bytes of an Arrow batch. By its rows alone (10,000) a batch of texts takes tens of megabytes
#: in the executor's JVM, twice that while its buffers grow, and as much in the Python worker.
BATCH_BYTES = 4 << 20


def small_batches(stage):
    """``stage`` with Arrow batches of BATCH_BYTES; the session keeps the setting, since a stage runs when its rows are asked for."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; learned from the labelled documents of the corpus."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir), threshold=0.5)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard.keep_one(docs, width=5, similarity="0.8")


@small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth repeats benchmark windows."""
    return decontam.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"), window=13, share=20)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text."""
    replaced = free_name(docs.columns, "_replaced")
    fresh = pii.pseudonymise(docs, key="corpus-surrogates", count_col=replaced)
    return fresh.withColumn("n_chars", F.when(F.col(replaced) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(replaced)


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path(), packing.Limits(tokens=2048), rule="residual")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("pii_surrogates", replace_personal_data),
    ("best_fit_packing", pack),
]

#: Classifier scores and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
