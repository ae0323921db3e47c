"""Lookups, caches, fetch results and ranks over records and their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.functions import text as X
from quellwerk.operators.analytics import quantiles, with_quantiles


def explode_citations(records: DataFrame, keys: list[str], citations: str = "citations") -> DataFrame:
    """A row per citation with its place; records without citations give none."""
    return records.select(*keys, F.size(citations).alias("total_citations"), F.posexplode(citations).alias("citation_index", "citation"))


def with_ranks(rows: DataFrame, record: str, score: str, refs: str, domain: str, place: str) -> DataFrame:
    """Unique score ranks, competition ranks by references, and domain counts. The
    three windows share one exchange on the record."""
    own = Window.partitionBy(record)
    rows = rows.withColumn("influence_rank", F.row_number().over(own.orderBy(F.col(score).desc(), place)))
    rows = rows.withColumn("rank_by_ref_count", F.rank().over(own.orderBy(F.col(refs).desc())))
    rows = rows.withColumn("same_domain_count", F.count(F.lit(1)).over(Window.partitionBy(record, domain)))
    return rows.withColumn("domain_is_unique", F.col("same_domain_count") == 1)


def first_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def with_fetch(citations: DataFrame, fetched: DataFrame, url: str = "url") -> DataFrame:
    """Fetch results by url, with the placeholder of a page never fetched; a fetched title
    replaces the parsed one."""
    right = fetched.select(F.col(url).alias("_url"), F.col("status_code").alias("_status"), F.col("title").alias("_title"), F.col("html").alias("_html"), F.col("fetch_error").alias("_error"), F.lit(True).alias("_hit"))
    joined = citations.join(right, citations[url] == F.col("_url"), "left")
    missing = F.col("_hit").isNull()
    return joined.select(
        *[c for c in citations.columns if c != "title"],
        F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.col("title") if "title" in citations.columns else F.lit("")).alias("title"),
        F.col("_status").alias("status_code"),
        F.coalesce("_html", F.lit("")).alias("fetched_html"),
        F.when(missing, "not_fetched").otherwise(F.coalesce("_error", F.lit(""))).alias("fetch_error"),
    )


def fetch_ok(html: Column, error: Column) -> Column:
    """P02."""
    return (F.coalesce(html, F.lit("")) != "") & (F.coalesce(error, F.lit("")) == "")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def tiered(rows: DataFrame, key: str, tiers: list[tuple[DataFrame, str]], name: str) -> DataFrame:
    """The first non-null value among several lookup tables, in order; of a key that a table
    repeats, its least value."""
    found = []
    for i, (table, value) in enumerate(tiers):
        rows = rows.join(table.groupBy(key).agg(F.min(value).alias(f"_t{i}")), key, "left")
        found.append(F.col(f"_t{i}"))
    return rows.withColumn(name, F.coalesce(*found)).drop(*[f"_t{i}" for i in range(len(tiers))])


def merge_authority(rows: DataFrame, other: DataFrame, keys: list[str], primary: str, rescaled: str) -> DataFrame:
    """The primary rank, else ten times the other source's, with its provenance."""
    joined = rows.join(other, keys, "left")
    final = F.coalesce(F.col(primary), F.col(rescaled) * 10)
    origin = F.when(F.col(primary).isNotNull(), "primary").when(F.col(rescaled).isNotNull(), "rescaled").otherwise("none")
    return joined.withColumn("final_rank", final).withColumn("origin", origin)


def backfill(records: DataFrame, fresh: DataFrame, key: str, value: str, failed: Column) -> DataFrame:
    """Replaces the value where it had failed and a fresh one exists; of several fresh
    ones, the least."""
    right = fresh.groupBy(key).agg(F.min(value).alias("_fresh"))
    return records.join(right, key, "left").withColumn(value, F.when(failed & F.col("_fresh").isNotNull(), F.col("_fresh")).otherwise(F.col(value))).drop("_fresh")


def labels_by_index(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Fenced JSON labels as rows (keys, idx, ...); what does not parse gives none,
    and of one idx the last label holds."""
    bare = F.regexp_replace(F.trim(F.col(text)), r"^```(?:json)?\s*|\s*```$", "")
    schema = "idx int, semantic_role string, relevance_score int, content_quality int, influence_type string"
    texts = rows.select(*keys, F.posexplode(F.from_json(bare, "array<string>")).alias("_p", "_t"))
    items = texts.select(*keys, "_p", F.from_json("_t", schema).alias("_i")).filter("_i.idx is not null")
    last = items.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_i.idx").orderBy(F.col("_p").desc()))).filter("_r = 1")
    blank = lambda c, v: F.coalesce(F.col(f"_i.{c}"), F.lit(v)).alias(f"llm_{c}")
    return last.select(*keys, F.col("_i.idx").alias("citation_index"), blank("semantic_role", ""), blank("relevance_score", 0), blank("content_quality", 0), blank("influence_type", ""))


def prompt_lines(files: DataFrame, blank: bool = True) -> DataFrame:
    """(layer, n, prompt) from whole files (name, value); n counts lines from 1, or without
    blank only those that hold something."""
    lines = F.split("value", "\r?\n")
    files = files.withColumn("_l", lines if blank else F.filter(F.transform(lines, lambda x: X.strip(x)), lambda x: x != ""))
    layer = F.regexp_replace(F.regexp_replace("name", "^prompt", ""), r"\.txt$", "")
    return files.select(layer.alias("layer"), F.posexplode("_l").alias("_p", "prompt")).select("layer", (F.col("_p") + 1).alias("n"), "prompt")


def attach_prompt(rows: DataFrame, prompts: DataFrame, base: str, number: str) -> DataFrame:
    """The n-th prompt of a layer, '' where there is none."""
    named = prompts.select(F.col("layer").alias(base), F.col("n").cast("long").alias(number), "prompt")
    return rows.join(named, [base, number], "left").withColumn("prompt", F.coalesce("prompt", F.lit("")))


def link_influence(pages: DataFrame, keys: list[str], links: str, url: str, blocks: str | None = None, strict: bool = False) -> DataFrame:
    """References and first place of a cited url among a page's links, inside the row, and
    with blocks (ranges over the links) how many text blocks hold one. An empty url matches nothing,
    or with strict every link, as in the published figures."""
    found = influence_columns(F.col(links), F.col(url), None if blocks is None else F.col(blocks), strict)
    rows = pages.withColumn("_at", matching_links(F.col(links), F.col(url), strict))
    return rows.select(*keys, url, *[c.alias(n) for n, c in found.items()])


def matching_links(links: Column, url: Column, strict: bool = False) -> Column:
    """The places of the links that refer to url: equal up to the query, or containing it."""
    bare = lambda c: F.substring_index(c, "?", 1)
    hit = lambda h: ((bare(h) == bare(url)) | F.contains(h, url)) & (F.lit(strict) | (url != ""))
    return F.filter(F.transform(links, lambda h, i: F.when(hit(h), i)), lambda i: i.isNotNull())


def influence_columns(links: Column, url: Column, blocks: Column | None, strict: bool = False, at: str = "_at") -> dict[str, Column]:
    """The columns of link_influence over a column named at with matching_links."""
    refs, n = F.size(at), F.greatest(F.size(links), F.lit(1))
    out = {"ref_count": refs, "first_position_ratio": F.round(F.when(refs > 0, F.get(at, F.lit(0)) / n).otherwise(1.0), 3)}
    if blocks is not None:
        covered = F.size(F.filter(blocks, lambda b: F.exists(at, lambda i: (i >= b["start"]) & (i < b["end"]))))
        total = F.size(blocks)
        out |= {"covered_paragraphs": covered, "total_answer_paragraphs": total, "paragraph_coverage_ratio": F.round(covered / F.greatest(total, F.lit(1)), 3)}
    return out


def url_totals(rows: DataFrame, platform: str, url: str) -> DataFrame:
    """Distinct urls per platform summed, distinct over all, and what sharing saves."""
    each = rows.groupBy(platform).agg(F.count_distinct(url).alias("n")).agg(F.sum("n").alias("raw_total"))
    return each.crossJoin(rows.agg(F.count_distinct(url).alias("distinct_total"))).withColumn("saved", F.col("raw_total") - F.col("distinct_total"))


def prompt_metrics(rows: DataFrame, by: list[str], prompt: str, triggered: Column, valid: Column) -> DataFrame:
    """Per group, the trigger rate and citations per observed and per triggered prompt."""
    each = rows.groupBy(*by, prompt).agg(F.bool_or(triggered).alias("_t"), F.count_if(valid).alias("_c"))
    stats = each.groupBy(*by).agg(F.count(F.lit(1)).alias("prompts"), (100 * F.count_if("_t") / F.count(F.lit(1))).alias("trigger_rate"), F.avg("_c").alias("per_prompt"), F.avg(F.when(F.col("_t"), F.col("_c"))).alias("per_triggered"), F.max("_c").alias("max"))
    return with_quantiles(stats, quantiles(each, "_c", [0.5], by), by, ["median"])
