"""The corpus operators as named queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quellwerk.llm import decontaminate, jaccard, langid, line_dedup, mixing, neighbours, quality, sharding, toxicity, warc
from quellwerk.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontaminate": lambda spark, d: decontaminate.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_nn_descent": lambda spark, d: neighbours.query(table(spark, d, "embeddings")),
    "op3_quality": lambda spark, d: quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_ngram_jaccard": lambda spark, d: jaccard.query(table(spark, d, "documents")),
    "op5_shards": lambda spark, d: sharding.query(table(spark, d, "documents")),
    "op6_arc_to_warc": lambda spark, d: warc.query(table(spark, d, "pages")),
    "op7_language": lambda spark, d: langid.query(table(spark, d, "documents")),
    "op8_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_line_dedup": lambda spark, d: line_dedup.query(table(spark, d, "documents")),
    "op10_mix": lambda spark, d: mixing.query(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op5_shards": sharding.ORACLE_SQL,
    "op6_arc_to_warc": warc.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
}
