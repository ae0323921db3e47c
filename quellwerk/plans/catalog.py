"""Named queries over the provided tables, each with its SQL counterpart where SQL has one.

The tables stand in for the pipeline's own: documents for cited pages' text, pages for their urls
and html, conversation turns for questions and answers, lineitem for numeric features, labels for
flags, and events for the search log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.functions import constants as K
from quellwerk.functions import text as X
from quellwerk.operators import analytics as A
from quellwerk.operators import html as H
from quellwerk.operators import records as R
from quellwerk.operators import search as L
from quellwerk.operators import similarity as S
from quellwerk.plans.registry import DOMAIN, DOMAIN_TYPE, GRAMS, HOST, ORACLES, PAIR_SQL, PATH, QUERIES, TOKENS, query
from quellwerk.plans.registry import all_of as _all
from quellwerk.plans.registry import cases as _cases
from quellwerk.plans.registry import quoted as _q

__all__ = ["ORACLES", "QUERIES"]

c = F.col
lit = F.lit


def pairs(t) -> DataFrame:
    """Question and answer turns: an assistant turn right after a user turn, by one window."""
    after = lambda column: F.lead(column).over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = t("conversations").withColumns({"a": after("text"), "_role": after("role"), "_turn": after("turn")})
    return turns.filter("role = 'user' and _role = 'assistant' and _turn = turn + 1").select("conv_id", "turn", c("text").alias("q"), "a")


# --- text -----------------------------------------------------------------------------------


@query(f"SELECT domain_type, count(*) AS pages, round(avg(w), 6) AS mean_words, round(quantile_cont(w, 0.5), 6) AS median_words, round(quantile_cont(w, 0.9), 6) AS p90_words FROM (SELECT {DOMAIN_TYPE} AS domain_type, len({TOKENS(f"regexp_replace(html, {_q(K.TAGS)}, ' ', 'g')")}) AS w FROM pages) GROUP BY 1")
def q_domain_type_words(t):
    rows = t("pages").select(X.domain_type(X.feature_domain(c("url"))).alias("domain_type"), F.size(X.tokens(X.strip_tags(c("html")))).alias("w"))
    found = A.quantiles(rows, "w", [0.5, 0.9], ["domain_type"])
    part = lambda i, name: F.round(F.get("quantiles", lit(i)), 6).alias(name)
    return found.select("domain_type", c("n").alias("pages"), F.round(c("sum") / c("n"), 6).alias("mean_words"), part(0, "median_words"), part(1, "p90_words"))


@query(f"SELECT doc_id, len({TOKENS('text')}) AS n_tokens, length(text) AS n_chars FROM documents")
def q_token_counts(t):
    return t("documents").select("doc_id", F.size(X.tokens(c("text"))).alias("n_tokens"), F.length("text").alias("n_chars"))


@query(f"SELECT doc_id, round(len(list_distinct(w)) / greatest(len(w), 1), 4) AS ratio FROM (SELECT doc_id, {_all('lower(text)', K.WORD)} AS w FROM documents)")
def q_unique_word_ratio(t):
    return t("documents").select("doc_id", X.unique_ratio(c("text")).alias("ratio"))


_PARTS = f"list_transform(regexp_split_to_array(text, '[.!?。！？]+'), lambda s: regexp_replace(s, {_q(f'^{K.SPACE}+|{K.SPACE}+$')}, '', 'g'))"


@query(f"""
SELECT doc_id, round(coalesce(list_avg(list_transform(list_filter({_PARTS}, lambda s: length(s) > 5),
         lambda s: len({_all('s', K.INK)}))), 0), 1) AS words
FROM documents""")
def q_sentence_length(t):
    return t("documents").select("doc_id", X.sentence_length(c("text")).alias("words"))


@query(f"""
SELECT doc_id, round(len(list_filter(w, lambda x: length(x) > 2 AND x NOT IN ({', '.join(map(_q, K.STOP_WORDS))}))) / greatest(len(w), 1), 3) AS density
FROM (SELECT doc_id, {_all('lower(text)', K.INK)} AS w FROM documents)""")
def q_info_density(t):
    return t("documents").select("doc_id", X.info_density(c("text")).alias("density"))


@query(f"SELECT doc_id, CASE WHEN k / greatest(k + l, 1) > 0.3 THEN 'zh' ELSE 'en' END AS lang FROM (SELECT doc_id, len({_all('text', '[一-鿿]')}) AS k, len({_all('text', '[a-zA-Z]')}) AS l FROM documents)")
def q_language_ratio(t):
    return t("documents").select("doc_id", X.language(c("text")).alias("lang"))


@query(f"SELECT doc_id, regexp_matches(text, {_q(K.HAS_NUMBERS)}) AS has_numbers, regexp_matches(text, {_q(K.HAS_DEFINITION)}) AS has_definition, regexp_matches(text, {_q(K.HAS_QA)}) AS has_qa_format, regexp_matches(text, {_q(K.HAS_HOWTO)}) AS has_howto, regexp_matches(text, {_q(K.HAS_COMPARISON)}) AS has_comparison FROM documents")
def q_content_flags(t):
    return t("documents").select("doc_id", *[f.alias(n) for n, f in X.content_flags(c("text")).items()])


@query(f"SELECT conv_id, turn, {_cases(K.QUESTION_RULES, 'regexp_matches(lower(trim(text)), {})', 'other')} AS question_type FROM conversations")
def q_question_type(t):
    return t("conversations").select("conv_id", "turn", X.question_type(c("text")).alias("question_type"))


@query("SELECT doc_id, substr(sha256(source || '/' || doc_id), 1, 16) AS record_id FROM documents")
def q_record_id(t):
    return t("documents").select("doc_id", X.record_id(F.concat_ws("/", "source", "doc_id")).alias("record_id"))


@query(f"SELECT page_id, {DOMAIN} AS domain, CASE WHEN contains({DOMAIN}, '.') THEN string_split({DOMAIN}, '.')[-1] ELSE '' END AS tld, {DOMAIN_TYPE} AS domain_type, len(list_filter(string_split({PATH}, '/'), lambda p: p <> '')) AS depth, list_has_any({_all(f"translate(lower({PATH}), '-_', '  ')", '[a-z]{3,}')}, ['casino', 'page', 'item']) AS keyword FROM pages")
def q_url_features(t):
    host = X.feature_domain(c("url"))
    return t("pages").select("page_id", host.alias("domain"), X.tld(host).alias("tld"), X.domain_type(host).alias("domain_type"), X.path_depth(c("url")).alias("depth"), X.url_keyword(c("url"), F.array(lit("casino"), lit("page"), lit("item"))).alias("keyword"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(h, '^[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}$') THEN h END AS domain, CASE WHEN regexp_replace(raw, '^www\\.', '') = '' THEN 'unknown' ELSE regexp_replace(raw, '^www\\.', '') END AS name FROM (SELECT page_id, {HOST} AS raw, regexp_replace(replace({HOST}, 'www.', ''), ':.*$', '') AS h FROM pages)")
def q_search_domain(t):
    return t("pages").select("page_id", X.search_domain(c("url")).alias("domain"), X.display_name(c("url")).alias("name"))


_OPEN = lambda tag: f"len(regexp_extract_all(h, '(?i)<{tag}[\\s>/]'))"
_SILENT = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"


@query(f"SELECT page_id, {' + '.join(_OPEN(f'h{i}') for i in range(1, 7))} AS heading_total, {_OPEN('p')} AS paragraphs, {_OPEN('ul')} + {_OPEN('ol')} AS lists, {_OPEN('li')} AS items, round({_OPEN('li')} / greatest({_OPEN('p')}, 1), 3) AS list_density, {_OPEN('table')} AS tables, {_OPEN('img')} AS images, {_OPEN('a')} AS link_count, {_OPEN('b')} + {_OPEN('strong')} AS bolds, {_OPEN('pre')} + {_OPEN('code')} AS codes FROM (SELECT page_id, regexp_replace(html, '{_SILENT}', '', 'g') AS h FROM pages)")
def q_page_structure(t):
    found = H.structure(H.parse_pages(t("pages").select("page_id", "html")))
    return found.select("page_id", "heading_total", "paragraphs", "lists", "items", "list_density", "tables", "images", "link_count", "bolds", "codes")


# --- similarity -----------------------------------------------------------------------------


@query(f"SELECT conv_id, turn, round(CASE WHEN len(list_distinct(x)) > 0 THEN len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(x)) ELSE 0 END, 3) AS title_match FROM (SELECT conv_id, turn, {TOKENS('q')} AS x, {TOKENS('a')} AS y FROM ({PAIR_SQL}))")
def q_title_match(t):
    return pairs(t).select("conv_id", "turn", X.overlap(X.tokens(c("q")), X.tokens(c("a")), 3).alias("title_match"))


_SHARED = "round(CASE WHEN len(list_distinct({0})) > 0 THEN len(list_intersect(list_distinct({0}), list_distinct({1}))) / len(list_distinct({0})) ELSE 0 END, 4)"


@query(f"SELECT conv_id, turn, {_SHARED.format('a2', 'q2')} AS bigram_overlap, {_SHARED.format('a3', 'q3')} AS trigram_overlap FROM (SELECT conv_id, turn, {GRAMS('x', 2)} AS a2, {GRAMS('y', 2)} AS q2, {GRAMS('x', 3)} AS a3, {GRAMS('y', 3)} AS q3 FROM (SELECT conv_id, turn, {TOKENS('a')} AS x, {TOKENS('q')} AS y FROM ({PAIR_SQL})))")
def q_ngram_overlap(t):
    words = pairs(t).select("conv_id", "turn", X.tokens(c("a")).alias("x"), X.tokens(c("q")).alias("y"))
    return words.select("conv_id", "turn", *[X.overlap(X.ngrams(c("x"), n), X.ngrams(c("y"), n), 4).alias(f"{name}_overlap") for n, name in ((2, "bigram"), (3, "trigram"))])


@query(f"WITH p AS ({PAIR_SQL}), w AS (SELECT conv_id, turn, 0 AS s, unnest({_all('lower(q)', K.TERM)}) AS term FROM p UNION ALL SELECT conv_id, turn, 1, unnest({_all('lower(a)', K.TERM)}) FROM p), k AS (SELECT conv_id, turn, term, (count(*) FILTER (WHERE s = 0))::DOUBLE AS a, (count(*) FILTER (WHERE s = 1))::DOUBLE AS c FROM w WHERE term NOT IN ({', '.join(map(_q, K.STOP_WORDS))}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY a + c DESC, term) AS r FROM k), z AS (SELECT conv_id, turn, sum(a * c) AS dot, sum(a * a * CASE WHEN a > 0 AND c > 0 THEN 1 ELSE {X.IDF_ONE**2} END) AS na, sum(c * c * CASE WHEN a > 0 AND c > 0 THEN 1 ELSE {X.IDF_ONE**2} END) AS nc FROM r WHERE r <= 5000 GROUP BY ALL) SELECT p.conv_id, p.turn, round(coalesce(CASE WHEN na > 0 AND nc > 0 THEN dot / (sqrt(na) * sqrt(nc)) END, 0), 4) AS tfidf_cosine FROM p LEFT JOIN z USING (conv_id, turn)")
def q_tfidf_cosine(t):
    return S.tfidf_cosine(pairs(t), ["conv_id", "turn"], "q", "a")


@query("SELECT x.vec_id, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) / sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])), 4) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def q_embedding_cosine(t):
    e = t("embeddings")
    other = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(X.cosine(c("embedding"), c("other")), 4).alias("cosine"))


_SCORE = "round(0.2 * least(l_linenumber / 3.0, 1.0) + 0.15 * (1 - l_discount) + 0.2 * l_tax + 0.25 * l_discount + 0.2 * (l_tax + l_discount) / 2, 4)"


def _scored(t) -> DataFrame:
    score = X.influence_score(c("l_linenumber"), c("l_discount"), c("l_tax"), c("l_discount"), c("l_tax"), c("l_discount"))
    return t("lineitem").withColumn("score", score)


@query(f"SELECT l_orderkey, l_linenumber, {_SCORE} AS influence_score FROM lineitem")
def q_influence_score(t):
    return _scored(t).select("l_orderkey", "l_linenumber", c("score").alias("influence_score"))


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS influence_rank, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rank_by_ref_count, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS same_domain_count, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) = 1 AS domain_is_unique FROM (SELECT *, {_SCORE} AS s FROM lineitem)")
def q_ranks(t):
    rows = _scored(t).withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return R.with_ranks(rows, "l_orderkey", "score", "l_quantity", "l_returnflag", "place").select("l_orderkey", "l_linenumber", "l_quantity", "influence_rank", "rank_by_ref_count", "same_domain_count", "domain_is_unique")


# --- records, lookups, fetch log ------------------------------------------------------------


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS citation_index, count(*) OVER (PARTITION BY conv_id) AS total_citations, role FROM conversations")
def q_citation_explode(t):
    records = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("citations"))
    return R.explode_citations(records, ["conv_id"]).select("conv_id", "citation_index", "total_citations", "citation.role")


@query("SELECT conv_id, turn, 0 AS citation_index, 'evidence' AS llm_semantic_role, conv_id AS llm_relevance_score, 0 AS llm_content_quality, '' AS llm_influence_type FROM conversations")
def q_llm_labels(t):
    text = F.format_string('```json\n[{"idx":0,"semantic_role":"definition","relevance_score":%d},{"idx":0,"semantic_role":"evidence","relevance_score":%d},5]\n```', c("turn"), c("conv_id"))
    return R.labels_by_index(t("conversations").select("conv_id", "turn", text.alias("json")), ["conv_id", "turn"], "json")


_EXC = "CASE event_id % 7 WHEN 0 THEN 'ReadTimeout: timed out' WHEN 1 THEN 'ConnectionError refused' WHEN 2 THEN 'SSLError certificate' WHEN 3 THEN 'getaddrinfo failed' WHEN 4 THEN 'ValueError odd' END"
_STATUS = "CASE event_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 ELSE 200 END"
_SNIPPET = "CASE WHEN event_id % 3 = 0 THEN 'Just a Moment...' ELSE event_type END"
_HIT = lambda signs: " OR ".join(f"contains(lower(e), {_q(s)})" for s in signs)
_CLASS = "CASE " + " ".join(f"WHEN e IS NOT NULL AND ({_HIT(signs)}) THEN {_q(label)}" for signs, label in K.EXCEPTION_RULES) + " WHEN s = 403 THEN 'forbidden' WHEN s = 404 THEN 'not_found' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_error' WHEN " + " OR ".join(f"contains(lower(substr(b, 1, 4096)), {_q(s)})" for s in K.BLOCK_PAGE_SIGNS) + " THEN 'js_challenge' WHEN e IS NOT NULL THEN 'unknown' ELSE '' END"
_LOG = f"SELECT event_id, {_CLASS} AS error_class FROM (SELECT event_id, {_EXC} AS e, {_STATUS} AS s, {_SNIPPET} AS b FROM events)"


def _classified(t) -> DataFrame:
    return t("events").select("event_id", X.error_class(F.expr(_EXC), F.expr(_STATUS), F.expr(_SNIPPET)).alias("error_class"))


@query(_LOG)
def q_error_class(t):
    return _classified(t)


@query(f"SELECT error_class AS value, count(*) AS n FROM ({_LOG}) WHERE error_class <> '' GROUP BY 1 ORDER BY n DESC, value")
def q_failure_histogram(t):
    return A.value_counts(_classified(t).filter("error_class <> ''"), "error_class").orderBy(c("n").desc(), "value")


@query("SELECT page_id, " + " OR ".join(f"contains(lower(substr(html, 1, 4096)), {_q(s)})" for s in K.BLOCK_PAGE_SIGNS) + " AS blocked FROM pages")
def q_block_page(t):
    return t("pages").select("page_id", X.is_block_page(c("html")).alias("blocked"))


@query("SELECT p.page_id, coalesce(nullif(d.source, ''), '') AS title, coalesce(length(d.text), 0) AS n_html, CASE WHEN d.doc_id IS NULL THEN 'not_fetched' ELSE CASE WHEN d.doc_id % 9 = 0 THEN 'timeout' ELSE '' END END AS fetch_error, d.doc_id IS NOT NULL AND d.text <> '' AND d.doc_id % 9 <> 0 AS fetch_ok FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 2")
def q_fetch_enrich_left(t):
    fetched = t("documents").select(c("doc_id").alias("url"), lit(200).alias("status_code"), c("source").alias("title"), c("text").alias("html"), F.when(c("doc_id") % 9 == 0, "timeout").alias("fetch_error"))
    out = R.with_fetch(t("pages").select("page_id", (c("page_id") * 2).alias("url")), fetched)
    return out.select("page_id", "title", F.length("fetched_html").alias("n_html"), "fetch_error", R.fetch_ok(c("fetched_html"), c("fetch_error")).alias("fetch_ok"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_resume_anti(t):
    return R.not_done(t("documents"), t("labels"), "doc_id").select("doc_id")


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 AND l.quality IS NOT NULL THEN l.quality ELSE -1 END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_retry_backfill(t):
    return R.backfill(t("documents").select("doc_id", lit(-1).alias("quality")), t("labels"), "doc_id", "quality", c("doc_id") % 3 == 0)


@query("SELECT (SELECT sum(n) FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag))::BIGINT AS raw_total, count(DISTINCT l_partkey) AS distinct_total, ((SELECT sum(n) FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag)) - count(DISTINCT l_partkey))::BIGINT AS saved FROM lineitem")
def q_url_dedup_summary(t):
    return R.url_totals(t("lineitem"), "l_returnflag", "l_partkey")


@query("SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, s * 10), 4) AS final_rank, CASE WHEN c_custkey % 2 = 0 THEN 'primary' WHEN s IS NOT NULL THEN 'rescaled' ELSE 'none' END AS origin FROM customer LEFT JOIN (SELECT s_nationkey, min(s_acctbal) AS s FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def q_final_dr(t):
    other = t("supplier").groupBy(c("s_nationkey").alias("k")).agg(F.min("s_acctbal").alias("dr"))
    rows = t("customer").select("c_custkey", c("c_nationkey").alias("k"), F.when(c("c_custkey") % 2 == 0, c("c_acctbal")).alias("rank"))
    return R.merge_authority(rows, other, ["k"], "rank", "dr").select("c_custkey", F.round("final_rank", 4).alias("final_rank"), "origin")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q_cache_last_wins(t):
    return R.first_by(t("events"), "user_id", [c("ts").desc(), c("event_id").desc()]).select("user_id", "event_type", "value")


@query("SELECT o_orderkey, coalesce(s_acctbal, c_acctbal, -1.0) AS v FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN customer ON c_custkey = o_custkey")
def q_tiered_lookup(t):
    rows = t("orders").select("o_orderkey", c("o_custkey").alias("k"))
    tiers = [(t("supplier").select(c("s_suppkey").alias("k"), "s_acctbal"), "s_acctbal"), (t("customer").select(c("c_custkey").alias("k"), "c_acctbal"), "c_acctbal")]
    return R.tiered(rows, "k", tiers, "v").select("o_orderkey", F.coalesce("v", lit(-1.0)).alias("v"))


@query("SELECT conv_id, turn, coalesce(p.prompt, '') AS prompt FROM conversations LEFT JOIN (SELECT conv_id AS layer, turn + 1 AS n, text AS prompt FROM conversations WHERE role = 'user') p ON p.layer = conv_id AND p.n = turn")
def q_prompt_attach(t):
    prompts = t("conversations").filter("role = 'user'").select(c("conv_id").alias("layer"), (c("turn") + 1).alias("n"), c("text").alias("prompt"))
    return R.attach_prompt(t("conversations").select("conv_id", "turn"), prompts, "conv_id", "turn").select("conv_id", "turn", "prompt")


@query("WITH x AS (SELECT DISTINCT o_custkey AS k, (o_orderkey % 20 + 1)::INT AS n FROM orders), m AS (SELECT k, max(n) AS m FROM x GROUP BY k) SELECT k, r.n::INT AS n FROM m, unnest(range(1, m + 1)) AS r(n) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = m.k AND x.n = r.n)")
def q_missing_ids(t):
    return A.missing_ids(t("orders").select(c("o_custkey").alias("k"), (c("o_orderkey") % 20 + 1).cast("int").alias("n")), "k", "n")


# --- search layer ---------------------------------------------------------------------------


@query("SELECT p.i AS ordinal, p.c AS category, coalesce(n, 0) AS n FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, 'none')) p(i, c) LEFT JOIN (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1) USING (c)")
def q_category_counts_zero(t):
    return A.counts_for(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "none"], "o_orderkey")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 1")
def q_argmax_prompt(t):
    return A.top_k(t("events").groupBy("user_id").agg(F.count(lit(1)).alias("n")), 1, [c("n").desc(), c("user_id")])


@query("SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def q_top20(t):
    return A.top_k(A.value_counts(t("lineitem"), "l_partkey"), 20, [c("n").desc(), c("value")])


@query("SELECT toxic AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def q_value_counts_null(t):
    return A.value_counts(t("documents").join(t("labels"), "doc_id", "left"), "toxic")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(quantile_cont(o_totalprice, 0.5), 2) AS median, count(o_totalprice) AS n FROM orders GROUP BY 1")
def q_rank_stats(t):
    return L.authority(t("orders"), "o_orderpriority", "o_totalprice")


_STYLE = "CASE user_id % 3 WHEN 1 THEN 'natural' WHEN 2 THEN 'source' ELSE 'role' END"


@query(f"SELECT style, round(avg(n), 2) AS mean FROM (SELECT {_STYLE} AS style, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def q_style_layer(t):
    each = t("events").groupBy(X.style_label(c("user_id")).alias("style"), "user_id").agg(F.count(lit(1)).alias("n"))
    return each.groupBy("style").agg(F.round(F.avg("n"), 2).alias("mean"))


@query("SELECT style, count(*) AS prompts, 100.0 * count(*) FILTER (WHERE t) / count(*) AS trigger_rate, round(avg(c), 6) AS per_prompt, round(avg(c) FILTER (WHERE t), 6) AS per_triggered, quantile_cont(c, 0.5) AS median, max(c) AS max FROM (SELECT user_id % 3 AS style, user_id, bool_or(event_type = 'purchase') AS t, count(*) FILTER (WHERE value > 10) AS c FROM events GROUP BY 1, 2) GROUP BY 1")
def q_prompt_metrics(t):
    found = R.prompt_metrics(t("events").withColumn("style", c("user_id") % 3), ["style"], "user_id", c("event_type") == "purchase", c("value") > 10)
    return found.select("style", "prompts", "trigger_rate", F.round("per_prompt", 6).alias("per_prompt"), F.round("per_triggered", 6).alias("per_triggered"), "median", "max")


@query("WITH m AS (SELECT l_returnflag AS f, l_linestatus AS s, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT s, round(avg(v), 6) AS mean_of_means, round(max(v) / min(v), 6) AS fold FROM m GROUP BY s")
def q_platform_means(t):
    means = t("lineitem").groupBy("l_returnflag", c("l_linestatus").alias("s")).agg(F.avg("l_quantity").alias("v"))
    return means.groupBy("s").agg(F.round(F.avg("v"), 6).alias("mean_of_means"), F.round(F.try_divide(F.max("v"), F.min("v")), 6).alias("fold"))


@query("SELECT source, round(100.0 * count(*) FILTER (WHERE lang IN ('en', 'fr', 'de')) / count(*), 6) AS three_share, round(avg((n_chars >= 500)::INT), 6) AS long_share FROM documents WHERE lang NOT IN ('unknown') GROUP BY 1")
def q_recognisable_share(t):
    known = t("documents").filter(~c("lang").isin("unknown"))
    return known.groupBy("source").agg(F.round(100 * F.count_if(c("lang").isin("en", "fr", "de")) / F.count(lit(1)), 6).alias("three_share"), F.round(F.avg((c("n_chars") >= 500).cast("int")), 6).alias("long_share"))


# --- influence layer ------------------------------------------------------------------------

NUMERIC = ["l_quantity", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT *, '{n}' AS feature, {n} AS v FROM lineitem" for n in NUMERIC)


# One feature does not vary and one has too few rows; of the others the two strongest are left.
@query(f"""
SELECT feature, n, round(r, 6) AS r FROM (
  SELECT feature, count(*) AS n, corr(v, l_extendedprice) AS r FROM (
    {_LONG} UNION ALL SELECT *, 'flat', 1.0 FROM lineitem UNION ALL SELECT *, 'rare', CASE WHEN l_orderkey <= 3 AND l_linenumber = 1 THEN l_tax END FROM lineitem)
  WHERE v IS NOT NULL GROUP BY 1)
WHERE n >= 30 AND feature <> 'flat' ORDER BY abs(r) DESC, feature LIMIT 2""")
def q_corr_rank(t):
    rows = t("lineitem").withColumns({"flat": lit(1.0), "rare": F.when((c("l_orderkey") <= 3) & (c("l_linenumber") == 1), c("l_tax"))})
    return A.correlation_rank(rows, "l_extendedprice", [*NUMERIC, "flat", "rare"], top=2).select("feature", "n", F.round("r", 6).alias("r"))


@query(f"SELECT l_returnflag, feature, count(*) AS n, round(corr(v, l_extendedprice), 6) AS r FROM ({_LONG}) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(r) DESC, feature) <= 2")
def q_platform_drivers(t):
    return A.correlation_rank(t("lineitem"), "l_extendedprice", NUMERIC, top=2, by=["l_returnflag"]).select("l_returnflag", "feature", "n", F.round("r", 6).alias("r"))


_FLAG = lambda f: f"SELECT '{f}' AS feature, avg(n_chars) FILTER (WHERE {f} = 1) AS a, avg(n_chars) FILTER (WHERE {f} = 0) AS b, count(*) FILTER (WHERE {f} = 1) AS n_true, count(*) FILTER (WHERE {f} = 0) AS n_false FROM documents JOIN labels USING (doc_id)"


@query(f"""
SELECT feature, round(a, 4) AS mean_true, round(b, 4) AS mean_false, n_true, n_false, round(a - b, 4) AS delta, round((a - b) / b, 4) AS lift,
       row_number() OVER (ORDER BY abs(a - b) DESC, feature) AS place FROM ({_FLAG('quality')} UNION ALL {_FLAG('toxic')})""")
def q_bool_lift(t):
    found = A.boolean_lift(t("documents").join(t("labels"), "doc_id"), ["quality", "toxic"], "n_chars")
    found = found.withColumn("place", F.row_number().over(Window.orderBy(F.abs("delta").desc(), "feature")))
    return found.select("feature", *[F.round(n, 4).alias(n) for n in ("mean_true", "mean_false", "delta", "lift")], "n_true", "n_false", "place")


@query("SELECT coalesce(p_brand, 'unknown') AS category, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(l_extendedprice) >= 20")
def q_category_mean(t):
    rows = t("lineitem").join(t("part"), c("l_partkey") == c("p_partkey"), "left")
    return A.category_mean(rows, "p_brand", "l_extendedprice").select("category", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


_BIN = "CASE WHEN n_chars >= 2000 THEN 3 WHEN n_chars >= 500 THEN 2 WHEN n_chars >= 100 THEN 1 WHEN n_chars >= 0 THEN 0 END"
_RBIN = "CASE WHEN n_chars > 2000 THEN 3 WHEN n_chars > 500 THEN 2 WHEN n_chars > 100 THEN 1 WHEN n_chars > 0 THEN 0 END"
_BINNED = "SELECT b AS bin, ['0-100', '100-500', '500-2000', '2000-+'][b + 1] AS label, count(quality) AS n, round(avg(quality), 6) AS mean, quantile_cont(quality, 0.5) AS median FROM (SELECT {} AS b, quality FROM documents JOIN labels USING (doc_id)) WHERE b IS NOT NULL GROUP BY 1, 2"


def _bins(t, right: bool) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id")
    return A.binned(rows, "n_chars", "quality", [0, 100, 500, 2000], right).select("bin", "label", "n", F.round("mean", 6).alias("mean"), "median")


@query(_BINNED.format(_BIN))
def q_binned(t):
    return _bins(t, False)


@query(_BINNED.format(_RBIN))
def q_binned_right(t):
    return _bins(t, True)


@query(f"""
SELECT feature, round(a, 6) AS first_mean, round(b, 6) AS second_mean, round(a - b, 6) AS delta, row_number() OVER (ORDER BY abs(round(a - b, 9)) DESC, feature) AS place
FROM (SELECT feature, avg(v) FILTER (WHERE l_returnflag = 'A') AS a, avg(v) FILTER (WHERE l_returnflag = 'R') AS b
      FROM ({_LONG} UNION ALL SELECT *, 'open', (l_linestatus = 'O')::INT FROM lineitem) GROUP BY 1)""")
def q_type_profile(t):
    found = A.type_profile(t("lineitem").withColumn("open", c("l_linestatus") == "O"), "l_returnflag", [*NUMERIC, "open"], "A", "R")
    place = F.row_number().over(Window.orderBy(F.abs(F.round("delta", 9)).desc(), "feature"))
    return found.withColumn("place", place).select("feature", *[F.round(n, 6).alias(n) for n in ("first_mean", "second_mean", "delta")], "place")


_TB = "SELECT {0} feature, round(avg(v) FILTER (WHERE l_extendedprice >= hi), 6) AS top_mean, round(avg(v) FILTER (WHERE l_extendedprice <= lo), 6) AS bottom_mean, round(avg(v) FILTER (WHERE l_extendedprice >= hi) - avg(v) FILTER (WHERE l_extendedprice <= lo), 6) AS delta, round(avg(v) FILTER (WHERE l_extendedprice >= hi) / nullif(avg(v) FILTER (WHERE l_extendedprice <= lo), 0), 6) AS ratio FROM ({1}) x JOIN (SELECT {0} quantile_cont(l_extendedprice, {2}) AS hi, quantile_cont(l_extendedprice, {3}) AS lo FROM lineitem {4}) y {5} GROUP BY ALL"
_MEANS = ("top_mean", "bottom_mean", "delta", "ratio")


@query(_TB.format("", _LONG, 0.8, 0.2, "", "ON true"))
def q_top_bottom(t):
    return A.top_bottom(t("lineitem"), "l_extendedprice", NUMERIC).select("feature", *[F.round(n, 6).alias(n) for n in _MEANS])


@query(_TB.format("", _LONG, 0.75, 0.25, "", "ON true"))
def q_top_bottom_quartile(t):
    return A.top_bottom(t("lineitem"), "l_extendedprice", NUMERIC, 0.25).select("feature", *[F.round(n, 6).alias(n) for n in _MEANS])


@query(_TB.format("", _LONG, 0.9, 0.1, "", "ON true"))
def q_top_bottom_decile(t):
    return A.top_bottom(t("lineitem"), "l_extendedprice", NUMERIC, 0.1).select("feature", *[F.round(n, 6).alias(n) for n in _MEANS])


# Part 1 has some thirty rows per 60,000 and is left out while it has fewer than fifty.
@query(f"""
WITH g AS (SELECT *, CASE WHEN l_partkey = 1 THEN 'P1' ELSE l_linestatus END AS s FROM lineitem),
z AS (SELECT s, count(*) AS n, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.8) AS hi, quantile_cont(l_extendedprice, 0.2) AS lo FROM g GROUP BY 1 HAVING count(*) >= 50),
x AS ({' UNION ALL '.join(f"SELECT s, l_extendedprice, '{n}' AS feature, {n} AS v FROM g" for n in NUMERIC)}),
d AS (SELECT s, feature, avg(v) FILTER (WHERE l_extendedprice >= hi) AS t, avg(v) FILTER (WHERE l_extendedprice <= lo) AS b FROM x JOIN z USING (s) GROUP BY 1, 2)
SELECT s, n AS rows, round(mean, 4) AS mean, round(median, 4) AS median, feature, round(t - b, 6) AS delta, round(t / nullif(b, 0), 6) AS ratio
FROM d JOIN z USING (s) QUALIFY row_number() OVER (PARTITION BY s ORDER BY abs(t - b) DESC, feature) <= 2""")
def q_slice_top_features(t):
    rows = t("lineitem").withColumn("s", F.when(c("l_partkey") == 1, "P1").otherwise(c("l_linestatus")))
    found = A.slice_drivers(rows, "s", "l_extendedprice", NUMERIC, top=2)
    return found.select("s", "rows", "feature", *[F.round(n, 4).alias(n) for n in ("mean", "median")], *[F.round(n, 6).alias(n) for n in ("delta", "ratio")])


@query(_TB.format("", "SELECT l_extendedprice, 'returned' AS feature, (l_returnflag = 'R')::INT AS v FROM lineitem UNION ALL SELECT l_extendedprice, 'open', (l_linestatus = 'O')::INT FROM lineitem", 0.8, 0.2, "", "ON true"))
def q_top_bottom_flags(t):
    rows = t("lineitem").withColumns({"returned": c("l_returnflag") == "R", "open": c("l_linestatus") == "O"})
    return A.top_bottom(rows, "l_extendedprice", ["returned", "open"]).select("feature", *[F.round(n, 6).alias(n) for n in _MEANS])


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.8) AS hi, quantile_cont(l_extendedprice, 0.2) AS lo FROM lineitem), s AS (SELECT l_returnflag AS k, count(*) FILTER (WHERE l_extendedprice >= hi) AS t, count(*) FILTER (WHERE l_extendedprice <= lo) AS b FROM lineitem, q GROUP BY 1) SELECT k, round(t / sum(t) OVER (), 6) AS top_share, round(b / sum(b) OVER (), 6) AS bottom_share FROM s")
def q_dist_compare(t):
    found = A.distribution_compare(t("lineitem"), "l_extendedprice", "l_returnflag")
    return found.select("k", F.round("top_share", 6).alias("top_share"), F.round("bottom_share", 6).alias("bottom_share"))


@query(f"SELECT feature, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90, min(v) AS min, max(v) AS max FROM ({_LONG}) GROUP BY 1")
def q_summary_stats(t):
    found = A.summary(t("lineitem"), NUMERIC)
    return found.select("feature", "n", *[F.round(n, 6).alias(n) for n in ("mean", "p10", "p25", "median", "p75", "p90")], "min", "max")


@query("SELECT source AS platform, count(*) AS total, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, count(quality) AS fetched, round(100.0 * count(quality) / count(*), 4) AS fetch_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def q_platform_overview(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").groupBy(c("source").alias("platform")).agg(F.count(lit(1)).alias("total"), F.count("quality").alias("fetched"))
    whole = A.Window.partitionBy()
    return rows.select("platform", "total", F.round(100 * c("total") / F.sum("total").over(whole), 4).alias("share"), "fetched", F.round(100 * c("fetched") / c("total"), 4).alias("fetch_rate"))


@query("SELECT user_id % 4 AS g, event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY user_id % 4), 6) AS share FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, event_type) <= 3")
def q_role_share(t):
    shares = A.share_within(t("events").withColumn("g", c("user_id") % 4), ["g"], "event_type")
    return A.top_k(shares, 3, [c("n").desc(), c("event_type")], ["g"]).select("g", "event_type", "n", F.round("share", 6).alias("share"))


# The other modules of queries register theirs when they are imported.
from quellwerk.plans import feature_queries, search_queries, source_queries  # noqa: E402, F401
