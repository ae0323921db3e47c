"""Queries over the feature table and its parts.

The records are made of the pages: a page with links to itself and to the next page is the answer, and
it cites itself, the next page, and a page whose fetch failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.functions import constants as K
from quellwerk.functions import text as X
from quellwerk.operators import features as V
from quellwerk.operators import html as H
from quellwerk.operators import records as R
from quellwerk.operators import similarity as S
from quellwerk.plans.registry import DOMAIN_TYPE, GRAMS, TOKENS, all_of, cases, query, quoted

c = F.col
lit = F.lit


def records(t) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    pages = t("pages").select("page_id", "url", "html", title.alias("title"))
    after = pages.select((c("page_id") - 1).alias("page_id"), c("url").alias("url2"), c("html").alias("html2"), c("title").alias("title2"))
    both = pages.join(after, "page_id", "left")
    escaped = lambda u: F.replace(F.coalesce(u, lit("")), lit("&"), lit("&amp;"))
    answer = F.concat(
        lit("<h2>About</h2>"), c("html"), lit('<ul><li><a href="'), escaped(c("url")), lit('">a</a></li><li><p>see <a href="'), escaped(c("url2")),
        lit('&amp;x=1">b</a></p></li></ul>'), F.when(c("page_id") % 2 == 0, "<table><tr><td>k</td></tr></table>").otherwise(""),
    )
    cited = lambda u, title, html, error: F.struct(
        F.coalesce(u, lit("")).alias("url"), lit("n").alias("display_name"), F.when(error == "", 200).alias("status_code"), F.coalesce(title, lit("")).alias("title"),
        F.coalesce(html, lit("")).alias("fetched_html"), lit("").alias("fetched_html_path"), error.alias("fetch_error"), error.alias("error_class"),
    )
    citations = F.array(cited(c("url"), c("title"), c("html"), lit("")), cited(c("url2"), c("title2"), c("html2"), lit("")), cited(lit("http://gone.example.org/a/b"), lit("gone"), lit("<p>x"), lit("timeout")))
    source = F.concat(lit("out/A_news/"), c("page_id").cast("string"), lit(".html"))
    return both.select("page_id", source.alias("source_file"), F.concat(lit("p"), (c("page_id") % 3).cast("string")).alias("platform"), lit("").alias("category"), c("title").alias("question"), answer.alias("answer_html"), citations.alias("citations"))


# --- the same in SQL --------------------------------------------------------------------------

_SPACES = f"{K.SPACE}+"
_STRIP = f"^{_SPACES}|{_SPACES}$"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, {quoted(_STRIP)}, '', 'g')"


def _unescaped(x: str) -> str:
    for entity, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


_SILENT = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"


def _visible(h: str) -> str:
    """Without scripts, styles and comments, which part texts."""
    return f"regexp_replace({h}, '{_SILENT}', '<x>', 'g')"


def _text(h: str) -> str:
    """The text nodes of a page, joined by spaces."""
    nodes = f"list_transform(regexp_split_to_array({_visible(h)}, '<[^>]*>'), lambda x: {_stripped(_unescaped('x'))})"
    return f"array_to_string(list_filter({nodes}, lambda x: x <> ''), ' ')"


def _open(h: str, *tags: str) -> str:
    return f"len(regexp_extract_all({h}, '(?i)<(?:{'|'.join(tags)})[\\s>/]'))"


def _hit(link: str) -> str:
    return f"(url <> '' AND (string_split({link}, '?')[1] = string_split(url, '?')[1] OR contains({link}, url)))"


#: Links of an answer whose first text block, or blocks, they stand in.
_LINKS = "list_transform(regexp_extract_all(answer, '<a [^>]*href=\"([^\"]*)\"', 1), lambda x: replace(x, '&amp;', '&'))"
_IN_ITEM = "list_transform(regexp_extract_all(answer, '<li>(?:<p>[^<]*)?<a [^>]*href=\"([^\"]*)\"', 1), lambda x: replace(x, '&amp;', '&'))"
_IN_PARAGRAPH = "list_transform(regexp_extract_all(answer, '<p>[^<]*<a [^>]*href=\"([^\"]*)\"', 1), lambda x: replace(x, '&amp;', '&'))"

BASE_SQL = f"""
pages0 AS (SELECT page_id, url, html, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages),
joined AS (SELECT p.*, coalesce(n.url, '') AS url2, coalesce(n.html, '') AS html2, coalesce(n.title, '') AS title2
           FROM pages0 p LEFT JOIN pages0 n ON n.page_id = p.page_id + 1),
answers AS (
  SELECT *, '<h2>About</h2>' || html || '<ul><li><a href="' || replace(url, '&', '&amp;') || '">a</a></li><li><p>see <a href="' ||
            replace(url2, '&', '&amp;') || '&amp;x=1">b</a></p></li></ul>' ||
            CASE WHEN page_id % 2 = 0 THEN '<table><tr><td>k</td></tr></table>' ELSE '' END AS answer FROM joined),
parsed AS (SELECT page_id, title AS question, answer, {_text('answer')} AS answer_text, {_visible('answer')} AS va FROM answers),
cited AS (
  SELECT page_id, 0 AS citation_index, url, title AS cit_title, html AS h, '' AS err FROM answers UNION ALL
  SELECT page_id, 1, url2, title2, html2, '' FROM answers UNION ALL
  SELECT page_id, 2, 'http://gone.example.org/a/b', 'gone', '<p>x', 'timeout' FROM answers),
rows AS (
  SELECT r.*, p.question, p.answer, p.answer_text, p.va, h <> '' AND err = '' AS fetch_ok,
         CASE WHEN h <> '' AND err = '' THEN {_visible('h')} ELSE '' END AS v,
         CASE WHEN h <> '' AND err = '' THEN {_text('h')} ELSE '' END AS cit_text,
         {_LINKS} AS links, list_concat({_IN_ITEM}, {_IN_PARAGRAPH}) AS placed
  FROM cited r JOIN parsed p USING (page_id)),
influence AS (
  SELECT *, list_transform(links, lambda l: {_hit('l')}) AS hits, len(list_filter(placed, lambda l: {_hit('l')})) AS covered_paragraphs,
         {_open('va', 'p', 'li', 'h3', 'h4')} AS total_answer_paragraphs FROM rows)
"""

_TERMS = f"""
words AS (
  SELECT page_id, citation_index, 0 AS side, unnest({all_of('lower(answer_text)', K.TERM)}) AS term FROM rows WHERE cit_text <> '' UNION ALL
  SELECT page_id, citation_index, 1, unnest({all_of('lower(cit_text)', K.TERM)}) FROM rows WHERE cit_text <> ''),
terms AS (
  SELECT page_id, citation_index, term, (count(*) FILTER (WHERE side = 0))::DOUBLE AS a, (count(*) FILTER (WHERE side = 1))::DOUBLE AS b
  FROM words WHERE term NOT IN ({', '.join(map(quoted, K.STOP_WORDS))}) GROUP BY ALL),
often AS (SELECT *, row_number() OVER (PARTITION BY page_id, citation_index ORDER BY a + b DESC, term) AS r FROM terms),
sums AS (
  SELECT page_id, citation_index, sum(a * b) AS dot, sum(a * a * CASE WHEN a > 0 AND b > 0 THEN 1 ELSE {X.IDF_ONE**2} END) AS na,
         sum(b * b * CASE WHEN a > 0 AND b > 0 THEN 1 ELSE {X.IDF_ONE**2} END) AS nb
  FROM often WHERE r <= {X.MOST_TERMS} GROUP BY ALL)
"""


def _share(wanted: str, given: str, digits: int) -> str:
    distinct = f"list_distinct({wanted})"
    return f"round(CASE WHEN len({distinct}) > 0 THEN len(list_intersect({distinct}, list_distinct({given}))) / len({distinct}) ELSE 0 END, {digits})"


_OK = lambda x, other: f"CASE WHEN fetch_ok THEN {x} ELSE {other} END"
_PARTS = f"list_filter(list_transform(regexp_split_to_array(cit_text, '[.!?。！？]+'), lambda s: {_stripped('s')}), lambda s: length(s) > 5)"
_INK = all_of("lower(cit_text)", K.INK)

FEATURE_SQL = f"""
WITH {BASE_SQL}, {_TERMS},
one AS (
  SELECT i.*, {TOKENS('answer_text')} AS aw, {TOKENS('cit_text')} AS cw, {TOKENS('question')} AS qw, coalesce(CASE WHEN na > 0 AND nb > 0 THEN dot / (sqrt(na) * sqrt(nb)) END, 0) AS cosine,
         {all_of('lower(cit_text)', K.WORD)} AS ww
  FROM influence i LEFT JOIN sums USING (page_id, citation_index)),
made AS (
  SELECT page_id, substr(sha256('out/A_news/' || page_id || '.html'), 1, 16) AS record_id, 'p' || page_id % 3 AS platform, 'A_news' AS category, question,
    {cases(K.QUESTION_RULES, f"regexp_matches(lower({_stripped('question')}), {{}})", 'other')} AS question_type,
    len(aw) AS answer_word_count, length(answer_text) AS answer_char_count, 3 AS total_citations,
    {_open('va', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6')} AS answer_heading_count, {_open('va', 'li')} AS answer_list_item_count,
    {_open('va', 'table')} > 0 AS answer_has_table, citation_index,
    url, 'n' AS display_name, cit_title, fetch_ok, CASE WHEN err = '' THEN 200 END AS status_code, err AS error_class,
    DOMAIN AS domain, CASE WHEN contains(DOMAIN, '.') THEN string_split(DOMAIN, '.')[-1] ELSE '' END AS domain_tld, {DOMAIN_TYPE} AS domain_type,
    len(list_filter(string_split(URLPATH, '/'), lambda p: p <> '')) AS path_depth,
    list_has_any({all_of("translate(lower(URLPATH), '-_', '  ')", '[a-z]{3,}')}, qw) AS url_has_query_keyword,
    length(cit_text) AS cit_char_count, len(cw) AS cit_word_count,
    {', '.join(f"{_open('v', f'h{i}')} AS cit_heading_h{i}" for i in range(1, 7))},
    {_open('v', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6')} AS cit_heading_total, {_open('v', 'p')} AS cit_paragraph_count,
    {_open('v', 'ul', 'ol')} AS cit_list_count, {_open('v', 'li')} AS cit_list_item_count,
    round({_open('v', 'li')} / greatest({_open('v', 'p')}, 1), 3) AS cit_list_density,
    {_open('v', 'table')} AS cit_table_count, {_open('v', 'img')} AS cit_image_count, {_open('v', 'a')} AS cit_link_count,
    {_open('v', 'b', 'strong')} AS cit_bold_count, {_open('v', 'pre', 'code')} AS cit_code_block_count, {_open('v', 'pre', 'code')} > 0 AS cit_has_code,
    {_OK(_share('qw', TOKENS('cit_title'), 3), '0.0')} AS title_question_match,
    round(len(list_filter({_INK}, lambda x: length(x) > 2 AND x NOT IN ({', '.join(map(quoted, K.STOP_WORDS))}))) / greatest(len({_INK}), 1), 3) AS cit_info_density,
    {_OK(f"regexp_matches(cit_text, {quoted(K.HAS_NUMBERS)})", 'false')} AS cit_has_numbers,
    {_OK(f"regexp_matches(cit_text, {quoted(K.HAS_DEFINITION)})", 'false')} AS cit_has_definition,
    {_OK(f"regexp_matches(cit_text, {quoted(K.HAS_QA)})", 'false')} AS cit_has_qa_format,
    {_OK(f"regexp_matches(cit_text, {quoted(K.HAS_HOWTO)})", 'false')} AS cit_has_howto,
    {_OK(f"regexp_matches(cit_text, {quoted(K.HAS_COMPARISON)})", 'false')} AS cit_has_comparison,
    {_OK(f"CASE WHEN len({all_of('cit_text', '[一-鿿]')}) / greatest(len({all_of('cit_text', '[a-zA-Z一-鿿]')}), 1) > 0.3 THEN 'zh' ELSE 'en' END", "''")} AS cit_language,
    round(coalesce(list_avg(list_transform({_PARTS}, lambda s: len({all_of('s', K.INK)}))), 0), 1) AS cit_avg_sentence_length,
    round(len(list_distinct(ww)) / greatest(len(ww), 1), 4) AS cit_unique_word_ratio,
    len(list_filter(hits, lambda x: x)) AS ref_count,
    round(CASE WHEN list_contains(hits, true) THEN (list_position(hits, true) - 1) / greatest(len(links), 1) ELSE 1.0 END, 3) AS first_position_ratio,
    covered_paragraphs, total_answer_paragraphs, round(covered_paragraphs / greatest(total_answer_paragraphs, 1), 3) AS paragraph_coverage_ratio,
    {_OK('round(cosine, 4)', '0.0')} AS tfidf_cosine,
    {_OK(_share(GRAMS('aw', 2), GRAMS('cw', 2), 4), '0.0')} AS bigram_overlap,
    {_OK(_share(GRAMS('aw', 3), GRAMS('cw', 3), 4), '0.0')} AS trigram_overlap
  FROM one),
scored AS (
  SELECT *, round(0.2 * least(ref_count / 3.0, 1.0) + 0.15 * (1 - first_position_ratio) + 0.2 * paragraph_coverage_ratio + 0.25 * tfidf_cosine
                  + 0.2 * (bigram_overlap + trigram_overlap) / 2, 4) AS influence_score FROM made)
SELECT * EXCLUDE (page_id), row_number() OVER (PARTITION BY record_id ORDER BY influence_score DESC, citation_index) AS influence_rank,
  count(*) OVER (PARTITION BY record_id, domain) AS same_domain_count, count(*) OVER (PARTITION BY record_id, domain) = 1 AS domain_is_unique,
  rank() OVER (PARTITION BY record_id ORDER BY ref_count DESC) AS rank_by_ref_count, 0.0 AS emb_answer_cit_cosine, 0.0 AS emb_question_cit_cosine,
  '' AS llm_semantic_role, 0 AS llm_relevance_score, 0 AS llm_content_quality, '' AS llm_influence_type
FROM scored
"""


def _urls(sql: str) -> str:
    """DOMAIN and URLPATH stand for the expressions over url."""
    from quellwerk.plans.registry import DOMAIN, PATH

    return sql.replace("DOMAIN", DOMAIN).replace("URLPATH", PATH)


# The mean of words per paragraph needs to know where unclosed paragraphs end, which a pattern cannot tell;
# it is tested on hand-made pages.
@query(_urls(FEATURE_SQL))
def q_feature_row(t):
    return V.features(records(t), most_chars=None).drop("cit_avg_para_words")


@query(f"""
WITH {BASE_SQL}
SELECT page_id, citation_index, len(list_filter(hits, lambda x: x)) AS ref_count,
  round(CASE WHEN list_contains(hits, true) THEN (list_position(hits, true) - 1) / greatest(len(links), 1) ELSE 1.0 END, 3) AS first_position_ratio,
  covered_paragraphs, total_answer_paragraphs, round(covered_paragraphs / greatest(total_answer_paragraphs, 1), 3) AS paragraph_coverage_ratio
FROM influence""")
def q_paragraph_coverage(t):
    rows = H.with_page(records(t).select("page_id", "answer_html", "citations.url"), c("answer_html"), "_p")
    cited = rows.select("page_id", c("_p.links").alias("links"), c("_p.blocks").alias("blocks"), F.posexplode("url").alias("citation_index", "url"))
    return R.link_influence(cited, ["page_id", "citation_index"], "links", "url", "blocks").drop("url")


@query(f"""
WITH {BASE_SQL}
SELECT page_id, {_open('va', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6')} AS answer_heading_count, {_open('va', 'li')} AS answer_list_item_count,
       {_open('va', 'table')} > 0 AS answer_has_table FROM parsed""")
def q_answer_structure(t):
    rows = H.with_page(records(t).select("page_id", "answer_html"), c("answer_html"), "_p")
    return rows.select("page_id", *[x.alias(n) for n, x in H.answer_structure("_p").items()])


@query(f"SELECT page_id, {_stripped(_unescaped("regexp_extract(html, '<title>(.*?)</title>', 1)"))} AS title, {_text('html')} AS text FROM pages")
def q_page_text(t):
    return H.parse_pages(t("pages").select("page_id", "html")).select("page_id", "title", "text")


@query("""
WITH d AS (SELECT doc_id, text, lag(text) OVER (ORDER BY doc_id) AS before FROM documents),
e AS (SELECT substr(sha256(substr(text, 1, 24300)), 1, 16) AS h, min(doc_id) AS k FROM documents WHERE trim(text) <> '' GROUP BY 1)
SELECT doc_id, round(CASE WHEN a.h IS NULL OR b.h IS NULL THEN 0 ELSE
         ((a.k % 7 + 1) * (b.k % 7 + 1) + (a.k % 5) * (b.k % 5)) / sqrt((a.k % 7 + 1)**2 + (a.k % 5)**2) / sqrt((b.k % 7 + 1)**2 + (b.k % 5)**2) END, 4) AS cosine
FROM d LEFT JOIN e a ON a.h = substr(sha256(substr(text, 1, 24300)), 1, 16) LEFT JOIN e b ON b.h = substr(sha256(substr(coalesce(before, ''), 1, 24300)), 1, 16)""")
def q_embedding_lookup(t):
    rows = t("documents").select("doc_id", "text")
    before = rows.select((c("doc_id") + 1).alias("doc_id"), c("text").alias("before"))
    rows = rows.join(before, "doc_id", "left")
    vector = F.array((c("k") % 7 + 1).cast("double"), (c("k") % 5).cast("double"))
    known = S.embedding_texts(rows, ["text"]).select("hash")
    first = rows.groupBy(S.text_hash(c("text")).alias("hash")).agg(F.min("doc_id").alias("k"))
    table = known.join(first, "hash").select("hash", vector.alias("embedding"))
    return S.with_embedding_cosines(rows, table, {"cosine": ("text", "before")}).select("doc_id", "cosine")


@query("""
SELECT conv_id, 'Question: ' || min(text) FILTER (WHERE turn = 0) || chr(10) || chr(10) || 'Sources:' || chr(10) ||
  string_agg('[' || turn || '] ' || role || ' | u' || turn || chr(10) || 'Content: ' || substr(text, 1, 800), chr(10) || chr(10) ORDER BY turn) AS prompt
FROM conversations GROUP BY conv_id""")
def q_label_prompt(t):
    turns = t("conversations")
    asked = turns.filter("turn = 0").select("conv_id", c("text").alias("question"))
    rows = turns.join(asked, "conv_id").select("conv_id", "question", lit("").alias("answer"), "turn", "role", F.concat(lit("u"), c("turn").cast("string")).alias("url"), "text")
    return S.label_prompts(rows, ["conv_id"], "question", "answer", "turn", "role", "url", "text", "Question: {question}{answer}\n\nSources:\n{citations}")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A_' || source WHEN doc_id % 3 = 1 THEN 'C_x' ELSE '' END AS category FROM documents""")
def q_infer_category(t):
    middle = F.when(c("doc_id") % 3 == 0, F.concat(lit("A_"), "source")).when(c("doc_id") % 3 == 1, lit("C_x/B_y")).otherwise("AB_/b_c")
    path = F.concat(lit("/out/"), middle, lit("/"), c("doc_id").cast("string"), lit(".html"))
    return t("documents").select("doc_id", X.infer_category(path).alias("category"))
