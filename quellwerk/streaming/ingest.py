"""Incremental ingestion: new record files once, failures again until they succeed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quellwerk.sources.readers import RECORD_SCHEMA


def ingest_records(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Transforms JSON-lines records that have arrived since the last run and appends them;
    the checkpoint remembers what is done. Returns the finished query."""
    records = spark.readStream.schema(RECORD_SCHEMA).json(source).filter("citations is not null")
    query = transform(records).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def refresh_cache(urls: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache with results for urls it lacks or that failed; fetch gets urls
    partitioned by domain, so that it can space requests of one domain."""
    ok = cache.filter("coalesce(fetch_error, '') = ''")
    wanted = urls.select("url").distinct().join(ok.select("url"), "url", "left_anti")
    domain = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    fresh = fetch(wanted.withColumn("domain", domain).repartition("domain").sortWithinPartitions("domain", "url"))
    return cache.join(fresh.select("url"), "url", "left_anti").unionByName(fresh)
