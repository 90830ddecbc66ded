"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixing and packing of the documents table.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
documents; the last returns packed pieces. Stages write nothing but their operators' tables in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.llm import mixing, quality_rules
from genomill.llm._common import free_name, fresh_dir, own, release
from genomill.llm.ngram_join import representatives
from genomill.llm.packing import pack
from genomill.llm.substring_dedup import repeated_passages, without_passages
from genomill.session import importable


#: Shares of words that the mixture aims at. The rules have taken the documents of low quality before, so there is no
#: domain of them here: the remainders of other documents' posteriors would be repeated thousands of times to fill it.
MIXTURE = {"clean": 0.94, "toxic": 0.06}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; null and empty texts don't, repeated rows all do or all don't."""
    name = free_name(docs.columns, "quality")
    return quality_rules.judge(docs, name=name).where(F.col(name)["kept"]).select(*map(own, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents one with the least doc_id; of rows with one doc_id in a class, one.

    Texts without words are one class. A class without any doc_id keeps one row too.
    """
    return representatives(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; n_chars follows the text, whose null stays null."""
    out = without_passages(docs, repeated_passages(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates towards the target weights say; repeated rows each on their own, no rows stay none."""
    labels = importable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resampled(docs, mixing.mix(docs, labels, targets=MIXTURE))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens; a null text is the end id alone, no rows give none."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_text", repeated_text), ("mixture", mixture), ("packing", packing)]
#: Jaccard classes, chains, a classifier and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's rows are written to the shared folder for the next."""
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        at = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            release(spark, before)
        before = at
    out = STAGES[-1][1](spark, docs, sf_dir)  # its rows come from its own checkpoints
    if before:
        release(spark, before)
    return out
