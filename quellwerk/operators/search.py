"""The search layer: which sites an answer engine cites, by layers of prompts.

A row is an answer (name, such as A_news12, B7, C3 or D41), whether it searched, and one domain it
cites with what is known of it: (name, triggered, domain, site_type, status, rank, language,
country, techs). Missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.functions import constants as K
from quellwerk.functions import text as X
from quellwerk.operators import analytics as A
from quellwerk.operators import records as R

YES = "是"
#: Statuses of a successful enrichment call.
DONE = ("成功", "获取成功")


# --- names -----------------------------------------------------------------------------------


def category_of(name: Column) -> Column:
    """The letters after A, with or without an underscore; null for other layers."""
    return F.nullif(F.regexp_extract(name, r"(A_?[a-zA-Z]+)", 1), F.lit(""))


def number_of(name: Column, layer: str) -> Column:
    """The number after a layer's letter."""
    return F.regexp_extract(name, rf"{layer}(\d+)", 1).try_cast("int")


def split_name(name: Column) -> tuple[Column, Column]:
    """Prefix and number of a name that is nothing else, nulls otherwise."""
    pattern = r"^([a-zA-Z_]+)(\d+)$"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.regexp_extract(name, pattern, 2).try_cast("int")


def sequence_of(file: Column, parts: int = 1) -> Column:
    """The number of an answer file, or with parts=2 its two numbers; 'null' where there is none."""
    if parts == 1:
        found = F.nullif(F.regexp_extract(file, r"(?i)b-[a-f0-9]+-(\d+)", 1), F.lit(""))
        return F.coalesce(found, F.lit("null"))
    pattern = r"b-[a-f0-9]+-(\d+)_(\d+)_"
    return F.array(*[F.coalesce(F.nullif(F.regexp_extract(file, pattern, i), F.lit("")), F.lit("null")) for i in range(1, parts + 1)])


def in_layer(rows: DataFrame, layer: str, name: str = "name") -> DataFrame:
    """P05."""
    return rows.filter(F.coalesce(F.startswith(F.col(name), F.lit(layer)), F.lit(False)))


def in_categories(rows: DataFrame, categories: list[str] = K.CATEGORIES, name: str = "name") -> DataFrame:
    """Rows with their category, of the allowed ones only."""
    return rows.withColumn("category", category_of(F.col(name))).filter(F.col("category").isin(categories))


def with_style(rows: DataFrame) -> DataFrame:
    """P10: layer B by style, three prompts a group."""
    n = number_of(F.col("name"), "B")
    return in_layer(rows, "B").withColumn("group", F.ceil(n / 3).cast("int")).withColumn("style", X.style_label(n))


def with_language(rows: DataFrame) -> DataFrame:
    """Layer C by language, odd numbers English, even ones Chinese, two prompts a group."""
    n = number_of(F.col("name"), "C")
    return in_layer(rows, "C").withColumn("group", F.ceil(n / 2).cast("int")).withColumn("version", F.when(n % 2 != 0, "EN").when(n.isNotNull(), "ZH"))


def with_scenario(rows: DataFrame) -> DataFrame:
    """Layer D by scenario."""
    return in_layer(rows, "D").withColumn("scenario", X.scenario_label(number_of(F.col("name"), "D")))


# --- predicates and cleaning -----------------------------------------------------------------


def valid_domain(domain: Column) -> Column:
    """P16."""
    return F.coalesce(~F.lower(F.trim(domain)).isin("", "null"), F.lit(False))


def to_rescue(rows: DataFrame) -> DataFrame:
    """Cited domains of searching answers whose enrichment did not succeed."""
    return rows.filter(~F.coalesce(F.col("status"), F.lit("")).isin(*DONE) & F.coalesce(F.col("triggered") == YES, F.lit(False)) & valid_domain(F.col("domain")))


def recognisable(rows: DataFrame) -> DataFrame:
    """Without unknown or worldwide countries and unknown languages."""
    known = lambda c, *out: F.coalesce(~F.lower(F.trim(c)).isin(*out), F.lit(False))
    return rows.filter(known("country", "unknown", "ww") & known("language", "unknown"))


def clean_type(site_type: Column) -> Column:
    """Q16: a status that slipped into the type column is no type."""
    return F.when(site_type.isin(*DONE), F.lit("unknown")).otherwise(site_type)


def unwanted_host(url: Column, hosts: list[str]) -> Column:
    """Whether the host is one of hosts or below one."""
    own = X.netloc(url)
    return F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (own == h) | F.endswith(own, F.concat(F.lit("."), h)))


def without_helpers(rows: DataFrame, *helpers: str) -> DataFrame:
    """Drops helper columns, where there are any."""
    return rows.drop(*helpers)


# --- layer statistics ------------------------------------------------------------------------


def citations_by_category(rows: DataFrame, categories: list[str] = K.CATEGORIES) -> DataFrame:
    """G01, O05."""
    return A.counts_for(rows.withColumn("category", category_of(F.col("name"))), "category", categories, "domain")


def most_cited_answer(rows: DataFrame) -> DataFrame:
    """The answer with most domains; the first by name of several."""
    counted = rows.filter("name is not null").groupBy("name").agg(F.count("domain").alias("n"))
    return A.top_k(counted, 1, [F.col("n").desc(), F.col("name")])


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, nulls left out."""
    return A.top_k(A.value_counts(rows.filter(F.col(column).isNotNull()), column), k, [F.col("n").desc(), F.col("value")])


def platforms_together(platforms: dict[str, DataFrame], k: int = 15) -> DataFrame:
    """The most cited domains over all platforms, with how many platforms cite each."""
    union = None
    for label, rows in platforms.items():
        part = rows.filter(valid_domain(F.col("domain"))).select(F.lit(label).alias("platform"), "domain")
        union = part if union is None else union.unionByName(part)
    counted = union.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("platform").alias("platforms"))
    return A.top_k(counted, k, [F.col("n").desc(), F.col("domain")])


def breadth(rows: DataFrame, by: str) -> DataFrame:
    """Distinct domains per group."""
    return rows.groupBy(by).agg(F.count_distinct("domain").alias("domains"))


def authority(rows: DataFrame, by: str, rank: str = "rank", digits: int = 2) -> DataFrame:
    """Mean, median and number of the ranks that are numbers."""
    value = X.number(F.col(rank).cast("string"))
    ranked = rows.withColumn("_v", value)
    stats = ranked.groupBy(by).agg(F.round(F.avg("_v"), digits).alias("mean"), F.count("_v").alias("n"))
    found = A.with_quantiles(stats, A.quantiles(ranked, "_v", [0.5], [by]), [by], ["median"])
    return found.select(by, "mean", F.round("median", digits).alias("median"), "n")


def prompts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per prompt: the flag, which is the first of its rows that have one in order of the
    domain, and the domains cited."""
    order = F.struct(F.col("domain").isNull(), "domain", "triggered")
    flag = F.min_by("triggered", F.when(F.col("triggered").isNotNull(), order))
    return rows.groupBy("name", *keys).agg(flag.alias("triggered"), F.count("domain").alias("citations"))


def trigger_rate(prompt_rows: DataFrame, by: str) -> DataFrame:
    """Percent of the prompts that searched, and their mean citations."""
    return prompt_rows.groupBy(by).agg((100 * F.count_if(F.col("triggered") == YES) / F.count(F.lit(1))).alias("trigger_rate"), F.round(F.avg("citations"), 2).alias("citations"), F.count(F.lit(1)).alias("prompts"))


def divergent_groups(prompt_rows: DataFrame) -> DataFrame:
    """Groups whose two versions do not agree on searching; a missing version disagrees."""
    wide = prompt_rows.groupBy("group").pivot("version", ["EN", "ZH"]).agg(F.min("triggered"))
    return wide.filter(~F.coalesce(F.col("EN") == F.col("ZH"), F.lit(False)))


def scenario_rates(rows: DataFrame, prompts_each: int = 10) -> DataFrame:
    """Distinct prompts of a scenario over those asked, and their mean citations."""
    each = rows.groupBy("scenario", "name").agg(F.count("domain").alias("c"))
    return each.groupBy("scenario").agg((100 * F.count(F.lit(1)) / F.lit(float(prompts_each))).alias("trigger_rate"), F.round(F.avg("c"), 1).alias("citations"))


def top_types(rows: DataFrame, by: str, column: str = "site_type", k: int = 3) -> DataFrame:
    """The k most frequent values per group with their share; nulls are left out."""
    shares = A.share_within(rows.filter(F.col(by).isNotNull()), [by], column)
    return A.top_k(shares, k, [F.col("n").desc(), F.col(column)], [by])


def technologies(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent parts of the technology texts, without what stands in brackets."""
    parts = rows.select(F.explode(F.split("techs", r"\|")).alias("value"))
    clean = parts.select(X.strip(F.regexp_replace("value", r"\[.*?\]", "")).alias("value")).filter("lower(value) not in ('', 'null')")
    return top_values(clean, "value", k)


def missing_prompts(rows: DataFrame) -> DataFrame:
    """(prefix, n) of the names that should exist up to each prefix's largest number."""
    prefix, number = split_name(F.col("name"))
    named = rows.select(prefix.alias("prefix"), number.alias("n")).filter("prefix is not null").distinct()
    return A.missing_ids(named, "prefix", "n")


def missing_total(rows: DataFrame) -> DataFrame:
    """Per prefix with gaps the missing numbers in order, and their total over all prefixes."""
    gaps = missing_prompts(rows).groupBy("prefix").agg(F.sort_array(F.collect_list("n")).alias("missing"))
    whole = F.sum(F.size("missing")).over(Window.partitionBy())
    return gaps.select("prefix", "missing", whole.cast("long").alias("total"))


def provenance(rows: DataFrame, other: DataFrame) -> DataFrame:
    """How many final ranks come from which source."""
    merged = R.merge_authority(rows, other, ["name", "domain"], "rank", "dr")
    return A.value_counts(merged, "origin")


def stubborn(first: DataFrame, second: DataFrame) -> DataFrame:
    """Domains that the first source did not enrich and the second does not know."""
    key = lambda rows: rows.select(F.lower(X.strip(F.col("domain"))).alias("domain")).distinct()
    failed = key(first.filter(~F.coalesce(F.col("status"), F.lit("")).isin(*DONE) & valid_domain(F.col("domain"))))
    return R.not_done(failed, key(second.filter(valid_domain(F.col("domain")))), "domain")


def failed_urls(failures: DataFrame) -> DataFrame:
    """The distinct urls to fetch again."""
    return failures.select("url").filter("coalesce(url, '') <> ''").distinct()


def sources_per_url(citations: DataFrame, url: str = "url", source: str = "source_file") -> DataFrame:
    """The files that cite each url, in order; one list per url, of distinct files."""
    return citations.select(url, source).distinct().groupBy(url).agg(F.sort_array(F.collect_list(source)).alias("source_files"))
