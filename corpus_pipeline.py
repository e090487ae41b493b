"""Corpus pipeline over ``documents``: each stage is written as Parquet and reread as the next one's input.

In every stage a null text counts as empty, texts are read whole whatever their length, an empty table
gives no rows, and columns beside those of ``documents``, whatever their names, are kept (packing, the
last stage, returns its own). Rows with null or repeated ids are rows like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorumlake.llm import exact_dedup, mixing, near_dedup, packing, quality_model
from quorumlake.llm.queries import TOKENIZER
from quorumlake.llm.scratch import bounded_batches, labels, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it predicts to be of low quality go.

    Rows with a null id are never learnt from; without labels nothing goes.
    """
    model = quality_model.fit_quality(docs, labels(spark, sf_dir))
    return docs.where(quality_model.scored(docs, model) >= quality_model.THRESHOLD)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays, one row of several with it; null ids lose to others."""
    bounded_batches(spark)
    return exact_dedup.exact_dedup(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays, that of the smallest doc_id, one row of several with
    it, and one with a null id only where the group has no other. Texts without words are linked with nothing."""
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents as often as the mix takes them, the last of a source cut after its
    words. A null source is a source; texts without words are in no mix."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of token ids in sequences; a text that the mix repeats is packed each time."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_distinct),
    ("near dedup", keep_unlike),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A fitted model and the library's token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
