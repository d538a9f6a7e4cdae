"""A corpus pipeline of the training-data operators.

Documents that the quality classifier rejects go; later copies of repeated line runs are deleted; of each
class of near-duplicates one document stays; documents that hold a benchmark item go; the rest is encoded
as byte-level BPE tokens and decoded again.  Every stage works on all that its predecessor kept, is written
as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontam, linedup, neardup, quality
from quarry.llm.common import fresh, released, scratch, table, written
from quarry.llm.queries import BYTE_BPE

#: The classifier is a trained model, which SQL cannot express; tests hold every stage against brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least the threshold; learned from labelled documents of ``docs``."""
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "quality_score")
    return quality.score(docs, forest, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs; n_chars follows the text."""
    out = linedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs, share=neardup.SHARE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of tokens and the digests of token ids and decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_filter), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("byte-level BPE", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
        if last is not None:
            released(last)
        last = docs
    return docs
