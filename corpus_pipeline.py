"""The corpus pipeline: five operators in a row, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the next stage's docs. All but the last return the columns of documents.

Defined cases: an empty table gives no rows; documents without text, or without a letter, go in the
first stage; a document without id is kept by all stages that its text passes, and is never a
duplicate; rows that repeat an id are one document, of which one row stays; columns beside those of
documents pass through, whatever their names, but for those that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quellwerk.llm import decontaminate, jaccard, langid, mixing, sharding
from quellwerk.llm.common import materialise, table, temporary


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 5-word shingles at a Jaccard of 0.8 or more."""
    return jaccard.remove_near_duplicates(docs, size=5, num=8, den=10)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources to their target weights; a pass over a document is a row."""
    return mixing.mixed_texts(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row its shard."""
    return sharding.assign(docs, sharding.LIMIT)


STAGES = [
    ("language", identify),
    ("near duplicates", near_duplicates),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Training and drawing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage wrote for itself goes when its result is written,
    and so does the result before."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with temporary(spark, *spent):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), outlive=1)
        spent = [docs]
    return docs
