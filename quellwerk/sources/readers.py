"""Sources and sinks with explicit schemas."""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions.constants import NA_TOKENS

CITATION = "struct<url string, display_name string, final_url string, status_code int, title string, fetched_html string, fetched_html_path string, fetch_error string, error_class string, body_snippet string, attempts int>"
RECORD_SCHEMA = f"source_file string, pair_file string, platform string, category string, title string, question string, answer_html string, citations array<{CITATION}>"
FAILURE_SCHEMA = "url string, error_class string, fetch_error string, status_code int, body_snippet string, attempts int, source_files array<string>, timestamp string, prev_timestamp string"


def read_html(spark: SparkSession, path: str, glob: str = "*.{html,htm}") -> DataFrame:
    """(path, html) of all pages below path; bytes that are not UTF-8 become U+FFFD and
    are removed; empty files, which hold no answer, give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("html"))


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Answer records of JSON files or JSON lines; broken ones and those without
    citations are left out."""
    schema = RECORD_SCHEMA + ", _corrupt_record string"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    rows = reader.option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true").json(path)
    return rows.filter(F.col("citations").isNotNull() & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_csv(spark: SparkSession, path: str, columns: list[str], na: bool = True) -> DataFrame:
    """A CSV with header and quoted line ends as strings; with na, the usual tokens for
    missing values become null, else an empty cell is the empty text."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return rows.select(*[null_tokens(F.col(f"`{c}`")).alias(c) if na else F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def null_tokens(column: Column) -> Column:
    return F.when(~column.isin(*NA_TOKENS), column)


def clean_header_rows(rows: DataFrame, column: str) -> DataFrame:
    """Without rows that repeat the header."""
    return rows.filter(F.coalesce(F.col(f"`{column}`"), F.lit("")) != column)


def read_features(spark: SparkSession, path: str, columns: list[str], booleans: list[str], numbers: list[str]) -> DataFrame:
    """A feature table from CSV: booleans by their truthy spellings, numbers or null."""
    from quellwerk.functions.text import number, truthy

    rows = read_csv(spark, path, columns)
    kind = lambda c: truthy(F.col(c)) if c in booleans else number(F.col(c)) if c in numbers else F.col(c)
    return rows.select(*[kind(c).alias(c) for c in columns])


def lookup_cache(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct urls with their cached result and whether it is a success; a url that the
    cache lacks, or has without a readable result, has neither."""
    keyed = cache.withColumn("_k", F.sha2("url", 256)).drop("url")
    wanted = urls.select("url").distinct().withColumn("_k", F.sha2("url", 256))
    found = wanted.join(keyed, "_k", "left").drop("_k")
    return found.withColumn("cached_ok", F.coalesce((F.col("fetch_error") == "") & (F.coalesce("fetched_html", F.lit("")) != ""), F.lit(False)))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Whole prompt files (name, value)."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("name"), "value")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """S09."""
    return spark.read.schema(FAILURE_SCHEMA).json(path)


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """The record ids of earlier output."""
    return spark.read.schema("record_id string").json(path).filter("record_id is not null").distinct()


def pair_files(files: DataFrame) -> DataFrame:
    """Each _0_ page with the first _1_ page of its folder."""
    parts = files.withColumn("_dir", F.regexp_extract("path", "^(.*)/", 1)).withColumn("_no", F.regexp_extract("path", r"_([01])_\d{3}_[^/]*$", 1))
    second = parts.filter("_no = '1'").groupBy("_dir").agg(F.min("path").alias("pair_path"))
    return parts.filter("_no = '0'").join(second, "_dir", "left").select("path", "pair_path")


def write_json_lines(rows: DataFrame, path: str, mode: str = "append", by: str | None = None) -> None:
    """JSON lines, a folder per platform if by names it."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)


def split_bodies(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, bodies): the records with every page moved out of their citations, which keep the
    path it is stored under, and (path, html) of the distinct pages. The path is of the url's hash."""
    path = lambda c: F.concat(F.lit("_citation_cache/"), F.sha2(c["url"], 256), F.lit(".html"))
    held = lambda c: F.coalesce(c["fetched_html"], F.lit("")) != ""
    slim = lambda c: c.withField("fetched_html_path", F.when(held(c), path(c)).otherwise(F.coalesce(c["fetched_html_path"], F.lit("")))).withField("fetched_html", F.lit(""))
    cited = records.select(F.explode("citations").alias("c")).filter(held(F.col("c")))
    bodies = cited.groupBy(path(F.col("c")).alias("path")).agg(F.max("c.fetched_html").alias("html"))
    return records.withColumn("citations", F.transform("citations", slim)), bodies


def write_index(records: DataFrame, path: str) -> None:
    """The index as JSON lines and the pages as a table beside it."""
    index, bodies = split_bodies(records)
    bodies.write.mode("overwrite").parquet(f"{path}/bodies")
    index.write.mode("overwrite").json(f"{path}/index")


def write_csv(rows: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """CSV files with header, in the order of columns, written in parallel; white space
    at the ends of a value stays."""
    writer = rows.select(*columns).write.mode(mode).option("header", "true").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


BOM = "\ufeff"


def export_csv(rows: DataFrame, file: str, columns: list[str], append: bool = False, bom: bool = True) -> int:
    """One local CSV file, opened by a byte order mark; appended rows follow the header
    that is there. Rows stream through the driver one partition at a time; for tables that one
    machine can hold, others are for write_csv. The number of rows written."""
    fresh = not (append and os.path.exists(file) and os.path.getsize(file))
    n = 0
    with open(file, "w" if fresh else "a", encoding="utf-8", newline="") as out:
        if fresh:
            out.write(BOM if bom else "")
        writer = csv.writer(out)
        if fresh:
            writer.writerow(columns)
        for row in rows.select(*columns).toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def with_prompt_second(rows: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The prompt as the third column, behind the two that name the answer."""
    others = [c for c in rows.columns if c != prompt]
    return rows.select(*others[:2], prompt, *others[2:])


def run_summary(rows: DataFrame, platform: str, ok: Column) -> DataFrame:
    """Fetched and failed per platform and in all, as a JSON text."""
    each = rows.groupBy(platform).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
    total = each.agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), F.sort_array(F.collect_list(F.struct(platform, "ok", "failed"))).alias("platforms"))
    return total.select(F.to_json(F.struct("ok", "failed", "platforms")).alias("summary"))
