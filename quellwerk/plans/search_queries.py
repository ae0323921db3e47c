"""Queries of the search layer. The search log is made of the events: an event is a cited domain of the
answer that the user's number names, in one of the layers A to D."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.functions import constants as K
from quellwerk.functions import text as X
from quellwerk.operators import analytics as A
from quellwerk.operators import records as R
from quellwerk.operators import search as L
from quellwerk.plans.registry import HOST, query
from quellwerk.sources.fetching import failure_log
from quellwerk.sources.readers import clean_header_rows

c = F.col
lit = F.lit


def _pick(number: str, values: list[str | None]) -> str:
    """One of the values by the number's remainder; reads alike in both SQL dialects."""
    shown = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


_AREAS = [*K.CATEGORIES, "Anews", "Atechnology", "A_other"]
_NAME = f"""CASE WHEN event_id % 41 = 0 THEN '文件名' WHEN event_id % 43 = 0 THEN NULL
  ELSE CASE user_id % 4 WHEN 0 THEN {_pick('user_id', _AREAS)} || user_id WHEN 1 THEN 'B' || user_id WHEN 2 THEN 'C' || (user_id % 37 + 1) ELSE 'D' || (user_id % 60) END END"""
_COLUMNS = {
    "event_id": "event_id",
    "name": _NAME,
    "triggered": "CASE event_type WHEN 'error' THEN '否' WHEN 'view' THEN NULL ELSE '是' END",
    "domain": "CASE WHEN event_id % 11 = 0 THEN 'null' WHEN event_id % 13 = 0 THEN NULL ELSE 'd' || (event_id * 7 % 97) || '.example.com' END",
    "site_type": _pick("event_id", [*K.SITE_TYPES, "成功", None]),
    "status": _pick("event_id", ["成功", "获取成功", "无数据", "网络异常", None]),
    "rank": "CASE WHEN event_id % 5 = 0 THEN '-' WHEN event_id % 17 = 0 THEN NULL ELSE '' || (event_id * 13 % 1000) END",
    "language": _pick("event_id", ["en", "zh", "unknown", "en", None]),
    "country": _pick("event_id", ["US", "WW", "CN", "unknown", "US", "DE"]),
    "techs": _pick("event_id", ["React [js] | nginx [server]", "nginx [null] |null| ", None, "PHP"]),
}
LOG_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM events"
_ROWS = f"WITH log AS (SELECT * FROM ({LOG_SQL}) WHERE coalesce(name, '') <> '文件名')"


def log(t) -> DataFrame:
    rows = t("events").select(*[F.expr(e).alias(n) for n, e in _COLUMNS.items()])
    return clean_header_rows(rows.withColumnRenamed("name", "文件名"), "文件名").withColumnRenamed("文件名", "name")


@query(f"{_ROWS} SELECT event_id, regexp_replace(name, '^A(news|technology)', 'A_\\1') AS name FROM log")
def q_header_clean(t):
    return log(t).select("event_id", X.prefixed_category(c("name")).alias("name"))


_CATEGORY = "nullif(regexp_extract(name, '(A_?[a-zA-Z]+)', 1), '')"
_ALLOWED = ", ".join(f"({i}, '{v}')" for i, v in enumerate(K.CATEGORIES))


@query(f"{_ROWS} SELECT p.i AS ordinal, p.c AS category, coalesce(n, 0) AS n FROM (VALUES {_ALLOWED}) p(i, c) LEFT JOIN (SELECT {_CATEGORY} AS c, count(domain) AS n FROM log GROUP BY 1) USING (c)")
def q_search_categories(t):
    return L.citations_by_category(log(t))


@query(f"{_ROWS} SELECT event_id, {_CATEGORY} AS category FROM log WHERE {_CATEGORY} IN ({', '.join(f"'{v}'" for v in K.CATEGORIES)})")
def q_search_allowed(t):
    return L.in_categories(log(t)).select("event_id", "category")


@query(f"""{_ROWS}
SELECT event_id, nullif(regexp_extract(name, '^([a-zA-Z_]+)(\\d+)$', 1), '') AS prefix,
  try_cast(nullif(regexp_extract(name, '^([a-zA-Z_]+)(\\d+)$', 2), '') AS INT) AS number,
  CASE WHEN starts_with(name, 'B') THEN try_cast(regexp_extract(name, 'B(\\d+)', 1) AS INT) END AS b,
  CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '' || event_id END AS seq FROM log""")
def q_search_names(t):
    prefix, number = L.split_name(c("name"))
    file = F.concat(F.when(c("event_id") % 3 == 0, "x-").otherwise("B-0af3-"), c("event_id").cast("string"), lit("_1_a.html"))
    return log(t).select("event_id", prefix.alias("prefix"), number.alias("number"), F.when(c("name").startswith("B"), L.number_of(c("name"), "B")).alias("b"), L.sequence_of(file).alias("seq"))


@query(f"{_ROWS} SELECT name, count(domain) AS n FROM log WHERE name IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 1")
def q_most_cited_answer(t):
    return L.most_cited_answer(log(t))


@query(f"""{_ROWS}
(SELECT 'country' AS feature, country AS value, count(*) AS n FROM log WHERE country IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 5) UNION ALL
(SELECT 'language', language AS value, count(*) AS n FROM log WHERE language IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 5)""")
def q_top_places(t):
    rows = log(t)
    top = lambda name: L.top_values(rows, name, 5).select(lit(name).alias("feature"), "value", "n")
    return top("country").unionByName(top("language"))


_STYLES = f"{_ROWS}, b AS (SELECT *, try_cast(regexp_extract(name, 'B(\\d+)', 1) AS INT) AS k FROM log WHERE starts_with(name, 'B')), s AS (SELECT *, CASE k % 3 WHEN 1 THEN 'natural' WHEN 2 THEN 'source' ELSE 'role' END AS style FROM b)"


@query(f"{_STYLES} SELECT style, count(DISTINCT domain) AS domains FROM s GROUP BY 1")
def q_style_breadth(t):
    return L.breadth(L.with_style(log(t)), "style")


@query(f"{_STYLES} SELECT style, round(avg(try_cast(rank AS DOUBLE)), 2) AS mean, round(quantile_cont(try_cast(rank AS DOUBLE), 0.5), 2) AS median, count(try_cast(rank AS DOUBLE)) AS n FROM s GROUP BY 1")
def q_style_authority(t):
    return L.authority(L.with_style(log(t)), "style")


@query(f"{_STYLES} SELECT style, site_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY style), 6) AS share FROM s WHERE site_type IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY style ORDER BY n DESC, site_type) <= 3")
def q_style_types(t):
    return L.top_types(L.with_style(log(t)), "style").select("style", "site_type", "n", F.round("share", 6).alias("share"))


_PROMPTS = f"""{_ROWS}, cc AS (SELECT *, try_cast(regexp_extract(name, 'C(\\d+)', 1) AS INT) AS k FROM log WHERE starts_with(name, 'C')),
p AS (SELECT name, ceil(any_value(k) / 2.0)::INT AS "group", CASE WHEN any_value(k) % 2 <> 0 THEN 'EN' ELSE 'ZH' END AS version,
             arg_min(triggered, (CASE WHEN domain IS NULL THEN '1' ELSE '0' END) || coalesce(domain, '') || '/' || triggered) FILTER (WHERE triggered IS NOT NULL) AS triggered,
             count(domain) AS citations FROM cc GROUP BY name)"""


def _versions(t) -> DataFrame:
    return L.prompts(L.with_language(log(t)), ["group", "version"])


@query(f"{_PROMPTS} SELECT * FROM p")
def q_prompt_rollup(t):
    return _versions(t)


@query(f"{_PROMPTS} SELECT version, 100.0 * count(*) FILTER (WHERE triggered = '是') / count(*) AS trigger_rate, round(avg(citations), 2) AS citations, count(*) AS prompts FROM p GROUP BY 1")
def q_trigger_rate(t):
    return L.trigger_rate(_versions(t), "version")


@query(f"""{_PROMPTS}, w AS (SELECT "group", min(triggered) FILTER (WHERE version = 'EN') AS "EN", min(triggered) FILTER (WHERE version = 'ZH') AS "ZH" FROM p GROUP BY 1)
SELECT * FROM w WHERE NOT coalesce("EN" = "ZH", false)""")
def q_language_layer(t):
    return L.divergent_groups(_versions(t))


@query(f"""{_ROWS}, d AS (SELECT *, try_cast(regexp_extract(name, 'D(\\d+)', 1) AS INT) AS u FROM log WHERE starts_with(name, 'D')),
e AS (SELECT CASE WHEN u BETWEEN 1 AND 10 THEN 'high_risk' WHEN u BETWEEN 11 AND 20 THEN 'vague' WHEN u BETWEEN 21 AND 30 THEN 'multi_constraint'
  WHEN u BETWEEN 31 AND 40 THEN 'long_decision' WHEN u BETWEEN 41 AND 50 THEN 'macro_trend' ELSE 'unknown' END AS scenario, name, count(domain) AS k FROM d GROUP BY 1, 2)
SELECT scenario, 100.0 * count(*) / 10 AS trigger_rate, round(avg(k), 1) AS citations FROM e GROUP BY 1""")
def q_scenario_layer(t):
    return L.scenario_rates(L.with_scenario(log(t)))


@query(f"""{_ROWS}, n AS (SELECT DISTINCT nullif(regexp_extract(name, '^([a-zA-Z_]+)(\\d+)$', 1), '') AS prefix, try_cast(nullif(regexp_extract(name, '^([a-zA-Z_]+)(\\d+)$', 2), '') AS INT) AS n FROM log),
m AS (SELECT prefix, max(n) AS m FROM n WHERE prefix IS NOT NULL GROUP BY 1),
g AS (SELECT prefix, r.k::INT AS k FROM m, unnest(range(1, m + 1)) AS r(k) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.prefix = m.prefix AND n.n = r.k))
SELECT prefix, array_to_string(list_sort(list(k)), ',') AS missing, (sum(count(*)) OVER ())::BIGINT AS total FROM g GROUP BY prefix""")
def q_missing_total(t):
    found = L.missing_total(log(t))
    return found.select("prefix", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), "total")


@query(f"""{_ROWS}, k AS (SELECT DISTINCT name, domain FROM log WHERE event_id % 2 = 0 AND domain IS NOT NULL AND name IS NOT NULL)
SELECT CASE WHEN try_cast(rank AS DOUBLE) IS NOT NULL THEN 'primary' WHEN k.name IS NOT NULL THEN 'rescaled' ELSE 'none' END AS value, count(*) AS n
FROM log LEFT JOIN k ON k.name = log.name AND k.domain = log.domain GROUP BY 1""")
def q_provenance(t):
    rows = log(t)
    other = rows.filter("event_id % 2 = 0 and domain is not null and name is not null").groupBy("name", "domain").agg(lit(5.0).alias("dr"))
    return L.provenance(rows.withColumn("rank", X.number(c("rank"))), other)


_VALID = "coalesce(lower(trim(domain)) NOT IN ('', 'null'), false)"


@query(f"{_ROWS} SELECT domain, count(*) AS n, count(DISTINCT user_kind) AS platforms FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS user_kind FROM log) WHERE {_VALID} GROUP BY 1 ORDER BY n DESC, domain LIMIT 15")
def q_platforms_together(t):
    rows = log(t)
    return L.platforms_together({"a": rows.filter("event_id % 3 = 0"), "b": rows.filter("event_id % 3 <> 0")})


@query(f"{_ROWS} SELECT event_id FROM log WHERE coalesce(status, '') NOT IN ('成功', '获取成功') AND triggered = '是' AND {_VALID}")
def q_rescue(t):
    return L.to_rescue(log(t)).select("event_id")


@query(f"{_ROWS} SELECT event_id, CASE WHEN site_type IN ('成功', '获取成功') THEN 'unknown' ELSE site_type END AS site_type FROM log WHERE lower(country) NOT IN ('unknown', 'ww') AND lower(language) <> 'unknown'")
def q_recognisable(t):
    return L.recognisable(log(t)).select("event_id", L.clean_type(c("site_type")).alias("site_type"))


@query(f"{_ROWS} SELECT value, count(*) AS n FROM (SELECT trim(regexp_replace(unnest(string_split(techs, '|')), '\\[.*?\\]', '', 'g')) AS value FROM log) WHERE lower(value) NOT IN ('', 'null') GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def q_technologies(t):
    return L.technologies(log(t))


@query(f"""{_ROWS}, f AS (SELECT DISTINCT lower(trim(domain)) AS domain FROM log WHERE coalesce(status, '') NOT IN ('成功', '获取成功') AND {_VALID})
SELECT domain FROM f WHERE domain NOT IN (SELECT 'd' || (s_suppkey % 90) || '.example.com' FROM supplier)""")
def q_stubborn(t):
    other = t("supplier").select(F.concat(lit(" D"), (c("s_suppkey") % 90).cast("string"), lit(".example.com")).alias("domain"))
    return L.stubborn(log(t), other)


@query(f"SELECT page_id, {HOST} = 'example.net' OR ends_with({HOST}, '.example.net') OR {HOST} = 'example.org' OR ends_with({HOST}, '.example.org') AS unwanted FROM pages")
def q_unwanted_host(t):
    return t("pages").select("page_id", L.unwanted_host(c("url"), ["example.net", "example.org"]).alias("unwanted"))


_KIND = _pick("event_id", ["", "timeout", "", "dns"])
_URL = "'http://' || (user_id % 50)"


@query(f"""WITH r AS (SELECT {_URL} AS url, event_id, {_KIND} AS kind FROM events),
u AS (SELECT url, arg_min(kind, event_id) AS error_class FROM r GROUP BY 1),
s AS (SELECT url, list_sort(list(DISTINCT event_id % 30)) AS files FROM r GROUP BY 1)
SELECT url, error_class, array_to_string(files, ',') AS files FROM u JOIN s USING (url) WHERE error_class <> ''""")
def q_failure_log(t):
    rows = t("events").select(F.expr(_URL).alias("url"), "event_id", F.expr(_KIND).alias("kind"), (c("event_id") % 30).alias("source_file"))
    results = R.first_by(rows, "url", [c("event_id")]).select("url", c("kind").alias("error_class"), c("kind").alias("fetch_error"), lit(None).cast("int").alias("status_code"), lit("b").alias("body_snippet"), lit(1).alias("attempts"))
    lists = L.sources_per_url(rows).withColumn("source_files", F.transform("source_files", lambda x: x.cast("string")))
    return failure_log(results, lists, "now").select("url", "error_class", F.array_join("source_files", ",").alias("files"))


@query(f"SELECT DISTINCT {_URL} AS url FROM events")
def q_failed_urls(t):
    return L.failed_urls(t("events").select(F.expr(_URL).alias("url")))


@query("SELECT doc_id, source, coalesce(k, -1) AS k FROM documents LEFT JOIN (SELECT text AS tx, min(doc_id) AS k FROM documents GROUP BY 1) ON tx = text ORDER BY doc_id LIMIT 5")
def q_preview(t):
    from quellwerk.plans.report import preview

    first = t("documents").groupBy("text").agg(F.min("doc_id").alias("k"))
    return preview(t("documents").join(first, "text", "left").select("doc_id", "source", F.coalesce("k", lit(-1)).alias("k")), [c("doc_id")])


@query("SELECT coalesce(o_orderstatus, 'unknown') AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def q_distribution(t):
    return A.distribution(t("orders"), "o_orderstatus").select("value", "n", F.round("share", 6).alias("share"))


@query("SELECT feature, round(avg(v), 6) AS share FROM (SELECT 'quality' AS feature, quality AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY 1")
def q_prevalence(t):
    return A.prevalence(t("labels"), ["quality", "toxic"]).select("feature", F.round("share", 6).alias("share"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def q_score_stats(t):
    return A.score_stats(t("orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", "n", *[F.round(x, 4).alias(x) for x in ("mean", "median", "p90")])
