"""The corpus pipeline: drop poor documents, exact and near copies and benchmark leaks, then pack what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from policylog.llm.common import crc_mod, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the byte-level convolutional classifier scores at 0.3 or more."""
    from policylog.llm.quality import keep_good, train

    model = train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    return keep_good(docs, model, 0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of equal texts."""
    from policylog.llm.exact_dedup import drop_duplicates

    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: shingles of five words, a similarity of 0.8 or more."""
    from policylog.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    from policylog.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens; a row per piece, as op5_packing returns."""
    import public_tokenizers

    from policylog.llm.packing import packed_digests

    return packed_digests(docs, public_tokenizers.path("word_bpe_49k.json"), cut="dropped", end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]
#: No stage but the exact dedup can be told in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
