"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), and its result is written and read as the next one's docs.

All stages but the last return the columns of documents, so that what a stage decides takes effect on the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import op2_token_planes, op3_minhash, op5_mixing, op7_decontamination, op9_quality
from chronoloom.llm.common import discard, importable, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    importable(spark)
    return op9_quality.score(docs, op9_quality.fit(docs, table(spark, sf_dir, "labels")), keep=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8 or more)."""
    importable(spark)
    return op3_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return op7_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    importable(spark)
    return op5_mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Files of token ids; a row for each document in them, from reading them back."""
    importable(spark)
    # the executors hold what the stages before have left: less at once than in op2 alone
    return op2_token_planes.read_digest(op2_token_planes.write_token_planes(docs, op2_token_planes.default_tokenizer(), piece_bytes=2 << 20, known=100_000))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Classifier, MinHash, mixing draws and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        new = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
