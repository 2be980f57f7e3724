"""A training corpus in five stages: quality, near-duplicates, decontamination, mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import decontaminate, mixing, quality, sharding, simhash_docs
from wakeline.llm.common import discard, scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier (operator 9), trained on the rows of `labels` that are not held out, scores 0.7 or more.

    Null and empty texts are scored like others; repeated rows stay or go together; without two kinds of labels all
    documents get the one label there is; an empty table gives none; all columns stay, whatever their names.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group linked by similarity 0.8 of five-word shingles (operator 5).

    Null and empty texts are one group; repeated rows are one document; a null id stays only where its group has no
    other; an empty table gives none; all columns stay, whatever their names.
    """
    return simhash_docs.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold less than 0.8 of the five-word shingles of every item of `benchmark` (operator 4).

    Null and empty texts, and items without words, match nothing; repeated rows stay or go together; empty tables
    are no error; all columns stay, whatever their names.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every epoch that a document is in, sources weighed by temperature (operator 7).

    The largest source runs once and none over twice, so every document stays. Null sources are one source; texts
    without words run with their block; repeated rows run alike; an empty table gives none; all columns stay.
    """
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and start_shard of every row, in shards 0 to 7 (operator 1).

    A null text counts as empty; repeated rows and null ids are rows like any others; ties go by number; an empty
    table gives none; other columns are ignored.
    """
    return sharding.place(docs)


STAGES = [("quality", good), ("near-duplicates", unique), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded)]

#: Training and near-duplicate groups are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next one reads it; only the last result stays in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    docs = STAGES[-1][1](spark, docs, sf_dir)
    discard(before)
    return docs
