"""Queries of the sources and sinks: tables are written, read back and compared with what went in.

What they write lies in spark.checkpoint.dir and stays, since the returned DataFrame still reads it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.functions import text as X
from quellwerk.operators import analytics as A
from quellwerk.operators import features as V
from quellwerk.operators import records as R
from quellwerk.plans.registry import query
from quellwerk.sources import readers
from quellwerk.streaming.ingest import ingest_records, refresh_cache

c = F.col
lit = F.lit


def _folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share, or on a local master a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp()).rstrip('/')}/sources/{label}-{uuid.uuid4().hex}"


def _records(t) -> DataFrame:
    """A record per page, which cites the page itself and a page that timed out."""
    cited = lambda url, html, error: F.struct(url.alias("url"), lit(200).alias("status_code"), html.alias("fetched_html"), lit("").alias("fetched_html_path"), error.alias("fetch_error"))
    citations = F.array(cited(c("url"), c("html"), lit("")), cited(lit("http://gone.example.org/"), lit(""), lit("timeout")))
    return t("pages").select(c("page_id").cast("string").alias("source_file"), lit("p").alias("platform"), c("url").alias("question"), c("html").alias("answer_html"), citations.alias("citations"))


_RECORDS = "SELECT page_id::VARCHAR AS source_file, sha256(html) AS answer_sha, 2 AS n_citations, url AS cited, length(html) AS cited_chars, 'timeout' AS error FROM pages"


def _shown(records: DataFrame) -> DataFrame:
    return records.select(
        "source_file", F.sha2("answer_html", 256).alias("answer_sha"), F.size("citations").alias("n_citations"), c("citations")[0]["url"].alias("cited"),
        F.length(c("citations")[0]["fetched_html"]).cast("long").alias("cited_chars"), c("citations")[1]["fetch_error"].alias("error"),
    )


@query(_RECORDS)
def q_records_round_trip(t):
    records = _records(t)
    path = _folder(records.sparkSession, "records")
    readers.write_json_lines(records, path, by="platform")
    return _shown(readers.read_records(records.sparkSession, path, lines=True))


@query(_RECORDS)
def q_stream_ingest(t):
    """The second run finds nothing new."""
    records = _records(t)
    spark, path = records.sparkSession, _folder(records.sparkSession, "stream")
    readers.write_json_lines(records, f"{path}/in")
    for _ in range(2):
        ingest_records(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", _shown)
    return spark.read.parquet(f"{path}/out")


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, coalesce(role, '') AS role, '\t ' || coalesce(text, '') || ' \"x\",\\ ' AS text FROM conversations")
def q_csv_round_trip(t):
    columns = ["conv_id", "turn", "role", "text"]
    rows = t("conversations").withColumn("text", F.concat(lit("\t "), F.coalesce("text", lit("")), lit(' "x",\\ ')))
    path = _folder(rows.sparkSession, "csv")
    readers.write_csv(rows, path, columns)
    return readers.read_csv(rows.sparkSession, path, columns, na=False)


_CELLS = ["1", " TRUE ", "yes", "Y", "no", "", "null", "0", "2.5", "-", "1e3", "nan", "1d"]
_CELL = "CASE event_id % 13 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_CELLS)) + " END"


@query(f"""SELECT event_id::VARCHAR AS event_id, lower(trim(cell)) IN ('1', 'true', 'yes', 'y') AS flag,
CASE WHEN cell IN ('1', '0', '2.5', '1e3') THEN cell::DOUBLE END AS number FROM (SELECT event_id, {_CELL} AS cell FROM events)""")
def q_feature_table(t):
    rows = t("events").select("event_id", F.expr(_CELL).alias("flag"), F.expr(_CELL).alias("number"))
    path = _folder(rows.sparkSession, "features")
    readers.write_csv(rows, path, rows.columns)
    return readers.read_features(rows.sparkSession, path, rows.columns, ["flag"], ["number"])


@query("""SELECT page_id::VARCHAR AS source_file, '_citation_cache/' || sha256(url) || '.html' AS path, 0 AS inline_chars,
max(html) OVER (PARTITION BY url) AS html FROM pages""")
def q_index_bodies(t):
    """K02 and back, S11: pages move out of the records and are found again by their path."""
    index, bodies = readers.split_bodies(_records(t))
    rows = index.select("source_file", c("citations")[0].alias("citation"))
    found = V.page_bodies(rows, bodies, most_chars=None)
    return found.select("source_file", c("citation.fetched_html_path").alias("path"), F.length("citation.fetched_html").alias("inline_chars"), c("_html").alias("html"))


_CACHE = "SELECT url, CASE min(page_id) % 3 WHEN 0 THEN '' WHEN 1 THEN 'timeout' END AS fetch_error, max(html) AS fetched_html FROM pages GROUP BY 1 HAVING min(page_id) % 5 <> 0"


@query(f"SELECT url, fetch_error, coalesce(fetch_error = '' AND coalesce(fetched_html, '') <> '', false) AS cached_ok FROM (SELECT DISTINCT url FROM pages) LEFT JOIN ({_CACHE}) USING (url)")
def q_cache_lookup(t):
    return readers.lookup_cache(t("pages").select("url"), _cache(t)).select("url", "fetch_error", "cached_ok")


def _cache(t) -> DataFrame:
    first = t("pages").groupBy("url").agg(F.min("page_id").alias("k"), F.max("html").alias("fetched_html")).filter("k % 5 <> 0")
    return first.select("url", F.when(c("k") % 3 == 0, "").when(c("k") % 3 == 1, "timeout").alias("fetch_error"), "fetched_html")


@query(f"""WITH cache AS ({_CACHE}) SELECT url, fetch_error FROM cache WHERE coalesce(fetch_error, '') = ''
UNION ALL SELECT url, 'again' FROM (SELECT DISTINCT url FROM pages) WHERE url NOT IN (SELECT url FROM cache WHERE coalesce(fetch_error, '') = '')""")
def q_refresh_cache(t):
    return refresh_cache(t("pages").select("url"), _cache(t).select("url", "fetch_error"), lambda d: d.select("url", lit("again").alias("fetch_error")))


_FILE = "'/d' || (user_id % 20) || '/x_' || (event_id % 3) || '_' || lpad('' || (event_id % 1000), 3, '0') || '_' || event_id || '.html'"


@query(f"""WITH f AS (SELECT {_FILE} AS path, user_id % 20 AS d, event_id % 3 AS k FROM events)
SELECT path, (SELECT min(s.path) FROM f s WHERE s.k = 1 AND s.d = f.d) AS pair_path FROM f WHERE k = 0""")
def q_pair_files(t):
    return readers.pair_files(t("events").select(F.expr(_FILE).alias("path")))


@query("""SELECT doc_id::VARCHAR AS layer, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n, line AS prompt FROM (
SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) WHERE line <> ''""")
def q_prompt_lines(t):
    files = t("documents").select(F.concat(lit("prompt"), c("doc_id").cast("string"), lit(".txt")).alias("name"), c("text").alias("value"))
    return R.prompt_lines(files, blank=False).select("layer", c("n").cast("long").alias("n"), "prompt")


@query("""WITH e AS (SELECT source AS platform, count(*) FILTER (WHERE quality = 1) AS ok, count(*) - count(*) FILTER (WHERE quality = 1) AS failed
FROM documents LEFT JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY 1)
SELECT '{"ok":' || sum(ok) || ',"failed":' || sum(failed) || ',"platforms":[' ||
string_agg('{"platform":"' || platform || '","ok":' || ok || ',"failed":' || failed || '}', ',' ORDER BY platform) || ']}' AS summary FROM e""")
def q_run_summary(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").filter("source is not null").withColumnRenamed("source", "platform")
    return readers.run_summary(rows, "platform", F.coalesce(c("quality") == 1, lit(False)))


_R = "((o_orderkey % 201 - 100) / 100.0)"


@query(f"""SELECT o_orderkey, CASE WHEN abs({_R}) >= 0.8 THEN 'very strong' WHEN abs({_R}) >= 0.6 THEN 'strong' WHEN abs({_R}) >= 0.4 THEN 'moderate'
WHEN abs({_R}) >= 0.2 THEN 'weak' ELSE 'very weak' END AS words FROM orders""")
def q_correlation_words(t):
    return t("orders").select("o_orderkey", A.correlation_words((c("o_orderkey") % 201 - 100) / 100.0).alias("words"))


@query("SELECT doc_id, left(text, 512) AS snippet, left(text, 300) AS tokens FROM documents")
def q_clip(t):
    return t("documents").select("doc_id", X.clip(c("text"), 512).alias("snippet"), X.clip_tokens(c("text"), most_tokens=100).alias("tokens"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'null' ELSE event_type || ' [' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE 'k ' || (user_id % 7) END
|| '] | T [analytics]' END AS techs FROM events""")
def q_tech_text(t):
    kind = F.struct(F.when(c("event_id") % 4 != 0, F.concat(lit("k\n"), (c("user_id") % 7).cast("string"))).alias("category"))
    techs = F.when(c("event_type") == "error", F.expr("cast(map() as map<string, struct<category: string>>)")).otherwise(F.create_map(c("event_type"), kind, lit("T"), F.struct(lit("analytics").alias("category"))))
    return t("events").select("event_id", X.tech_text(techs).alias("techs"))
