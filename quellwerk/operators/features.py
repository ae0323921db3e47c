"""The feature table: one row per citation of an answer record, 72 columns in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellwerk.functions import text as X
from quellwerk.operators import html as H
from quellwerk.operators import records as R
from quellwerk.operators import similarity as S

# --- fixed values: the columns of the published table, in its order, and their groups ---------
RECORD_COLUMNS = [
    "record_id", "platform", "category", "question", "question_type", "answer_word_count", "answer_char_count", "total_citations",
    "answer_heading_count", "answer_list_item_count", "answer_has_table", "citation_index",
]
IDENTITY_COLUMNS = ["url", "display_name", "cit_title", "fetch_ok", "status_code", "error_class", "domain", "domain_tld", "domain_type", "path_depth", "url_has_query_keyword"]
STRUCTURE_COLUMNS = [
    "cit_char_count", "cit_word_count", "cit_heading_h1", "cit_heading_h2", "cit_heading_h3", "cit_heading_h4", "cit_heading_h5", "cit_heading_h6",
    "cit_heading_total", "cit_paragraph_count", "cit_avg_para_words", "cit_list_count", "cit_list_item_count", "cit_list_density", "cit_table_count",
    "cit_image_count", "cit_link_count", "cit_bold_count", "cit_code_block_count", "cit_has_code",
]
QUALITY_COLUMNS = [
    "title_question_match", "cit_info_density", "cit_has_numbers", "cit_has_definition", "cit_has_qa_format", "cit_has_howto", "cit_has_comparison",
    "cit_language", "cit_avg_sentence_length", "cit_unique_word_ratio",
]
INFLUENCE_COLUMNS = [
    "ref_count", "first_position_ratio", "covered_paragraphs", "total_answer_paragraphs", "paragraph_coverage_ratio", "tfidf_cosine", "bigram_overlap",
    "trigram_overlap", "influence_score", "influence_rank", "same_domain_count", "domain_is_unique", "rank_by_ref_count",
]
MODEL_COLUMNS = ["emb_answer_cit_cosine", "emb_question_cit_cosine", "llm_semantic_role", "llm_relevance_score", "llm_content_quality", "llm_influence_type"]
FEATURE_COLUMNS = RECORD_COLUMNS + IDENTITY_COLUMNS + STRUCTURE_COLUMNS + QUALITY_COLUMNS + INFLUENCE_COLUMNS + MODEL_COLUMNS
BOOLEANS = ["answer_has_table", "fetch_ok", "url_has_query_keyword", "cit_has_code", "cit_has_numbers", "cit_has_definition", "cit_has_qa_format", "cit_has_howto", "cit_has_comparison", "domain_is_unique"]
OUTCOMES = ["ref_count", "first_position_ratio", "covered_paragraphs", "paragraph_coverage_ratio", "influence_score", "influence_rank", "rank_by_ref_count"]
CONTENT_NUMERIC = [c for c in STRUCTURE_COLUMNS + QUALITY_COLUMNS if c not in BOOLEANS and c != "cit_language"]
SEMANTIC_NUMERIC = ["tfidf_cosine", "bigram_overlap", "trigram_overlap", "emb_answer_cit_cosine", "emb_question_cit_cosine", "llm_relevance_score", "llm_content_quality"]
# -----------------------------------------------------------------------------------------------

#: Names of the structure columns by those of the parsed page.
_STRUCTURE_OF = {
    **{f"cit_heading_h{i}": f"heading_h{i}" for i in range(1, 7)}, "cit_heading_total": "heading_total", "cit_paragraph_count": "paragraphs",
    "cit_avg_para_words": "avg_para_words", "cit_list_count": "lists", "cit_list_item_count": "items", "cit_list_density": "list_density",
    "cit_table_count": "tables", "cit_image_count": "images", "cit_link_count": "link_count", "cit_bold_count": "bolds",
    "cit_code_block_count": "codes", "cit_has_code": "has_code",
}


def record_key(records: DataFrame) -> Column:
    """The id of a record: of its source file, or without one of its contents, so that records
    without a source file do not share an id."""
    contents = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("platform", "question", "answer_html")]), 256)
    return X.record_id(F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.concat(F.lit("#"), contents)))


def page_bodies(rows: DataFrame, bodies: DataFrame | None, most_chars: int | None = 5_000_000) -> DataFrame:
    """Rows (a citation struct) with its page as _html: inline, else from bodies (path, html),
    else empty; at most most_chars characters."""
    inline = F.nullif(F.col("citation.fetched_html"), F.lit(""))
    if bodies is not None:
        stored = bodies.select(F.col("path").alias("_path"), F.col("html").alias("_body"))
        rows = rows.join(stored, F.col("citation.fetched_html_path") == F.col("_path"), "left").drop("_path")
        inline = F.coalesce(inline, F.col("_body"))
    html = F.coalesce(inline, F.lit(""))
    return rows.withColumn("_html", html if most_chars is None else H.capped(html, most_chars)).drop("_body")


def _quality(text: Column, title: Column, question: Column) -> dict[str, Column]:
    return {
        "title_question_match": X.overlap(X.tokens(question), X.tokens(title), 3),
        "cit_info_density": X.info_density(text),
        **{f"cit_{name}": flag for name, flag in X.content_flags(text).items()},
        "cit_language": X.language(text),
        "cit_avg_sentence_length": X.sentence_length(text),
        "cit_unique_word_ratio": X.unique_ratio(text),
    }


def feature_rows(records: DataFrame, bodies: DataFrame | None = None, most_chars: int | None = 5_000_000, stop_words: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The first 66 columns, and answer_text and cit_text for the model columns.

    Answers and pages are parsed in passing, texts are compared within their row, and the ranks
    share one exchange on the record."""
    blank = F.lit("")
    given = lambda c: F.coalesce(c, blank)
    base = records.select(
        record_key(records).alias("record_id"), given("platform").alias("platform"),
        F.coalesce(F.nullif(F.col("category"), blank), X.infer_category(given("source_file"))).alias("category"),
        given("question").alias("question"), given("answer_html").alias("_answer_html"), "citations",
    )
    answers = H.with_page(base, F.col("_answer_html"), "_answer").drop("_answer_html")
    context = {
        "question_type": X.question_type(F.col("question")), "answer_text": F.coalesce("_answer.text", blank),
        "answer_word_count": F.size(X.tokens(F.coalesce("_answer.text", blank))), "answer_char_count": F.length(F.coalesce("_answer.text", blank)),
        "total_citations": F.size("citations"), **{n: F.coalesce(c, F.lit(False) if n == "answer_has_table" else F.lit(0)) for n, c in H.answer_structure("_answer").items()},
        "_links": F.coalesce("_answer.links", F.array().cast("array<string>")), "_blocks": F.coalesce("_answer.blocks", F.array().cast("array<struct<start:int,end:int>>")),
    }
    rows = answers.select("record_id", "platform", "category", "question", *[c.alias(n) for n, c in context.items()], F.posexplode("citations").alias("citation_index", "citation"))
    rows = page_bodies(rows, bodies, most_chars)
    ok = R.fetch_ok(F.col("_html"), F.col("citation.fetch_error"))
    url = given("citation.url")
    rows = rows.withColumns({"fetch_ok": ok, "url": url, "display_name": given("citation.display_name"), "cit_title": given("citation.title"), "status_code": F.col("citation.status_code"), "error_class": given("citation.error_class")})
    rows = H.with_page(rows.withColumn("_html", F.when(F.col("fetch_ok"), F.col("_html"))).drop("citation"), F.col("_html"), "_page").drop("_html")
    words = X.tokens(F.col("question"))
    domain = X.feature_domain(F.col("url"))
    rows = rows.withColumns({"domain": domain, "domain_tld": X.tld(domain), "domain_type": X.domain_type(domain), "path_depth": X.path_depth(F.col("url")), "url_has_query_keyword": X.url_keyword(F.col("url"), words)})

    # A page without content has zeros, False and empty texts.
    text = F.coalesce("_page.text", blank)
    zero = {"int": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False), "string": blank}
    rows = rows.withColumn("cit_text", F.when(F.col("fetch_ok"), text).otherwise(blank))
    found = {"cit_char_count": F.length("cit_text"), "cit_word_count": F.size(X.tokens(F.col("cit_text")))}
    page = H.structure_columns("_page")
    found |= {name: page[source] for name, source in _STRUCTURE_OF.items()} | _quality(F.col("cit_text"), F.col("cit_title"), F.col("question"))
    kinds = dict(rows.select(*[c.alias(n) for n, c in found.items()]).dtypes)
    found = {n: F.when(F.col("fetch_ok"), F.coalesce(c, zero[kinds[n]])).otherwise(zero[kinds[n]]) for n, c in found.items()}
    rows = rows.withColumn("_at", R.matching_links(F.col("_links"), F.col("url"), strict)).withColumns(found)
    rows = rows.withColumns(R.influence_columns(F.col("_links"), F.col("url"), F.col("_blocks"))).drop("_at", "_links", "_blocks", "_page")

    both = (X.strip(F.col("answer_text")) != "") & (X.strip(F.col("cit_text")) != "")
    own, other = X.tokens(F.col("answer_text")), X.tokens(F.col("cit_text"))
    compared = {"tfidf_cosine": X.tfidf_cosine(F.col("answer_text"), F.col("cit_text"), **({} if stop_words is None else {"stop_words": stop_words}))}
    compared |= {f"{name}_overlap": X.overlap(X.ngrams(own, n), X.ngrams(other, n), 4) for n, name in ((2, "bigram"), (3, "trigram"))}
    rows = rows.withColumns({n: F.when(both, c).otherwise(0.0) for n, c in compared.items()})
    score = X.influence_score(*[F.col(c) for c in ("ref_count", "first_position_ratio", "paragraph_coverage_ratio", "tfidf_cosine", "bigram_overlap", "trigram_overlap")])
    return R.with_ranks(rows.withColumn("influence_score", score), "record_id", "influence_score", "ref_count", "domain", "citation_index")


def features(records: DataFrame, embeddings: DataFrame | None = None, labels: DataFrame | None = None, **options) -> DataFrame:
    """The 72 columns. embeddings has (hash, embedding), labels (record_id, citation_index and the
    llm columns); without them their columns hold zeros and empty texts, never null."""
    rows = feature_rows(records, **options)
    cosines = {"emb_answer_cit_cosine": ("answer_text", "cit_text"), "emb_question_cit_cosine": ("question", "cit_text")}
    rows = rows.withColumns(dict.fromkeys(cosines, F.lit(0.0))) if embeddings is None else S.with_embedding_cosines(rows, embeddings, cosines)
    empty = {"llm_semantic_role": F.lit(""), "llm_relevance_score": F.lit(0), "llm_content_quality": F.lit(0), "llm_influence_type": F.lit("")}
    if labels is None:
        return rows.withColumns(empty).select(*FEATURE_COLUMNS)
    joined = rows.join(labels.select("record_id", "citation_index", *empty), ["record_id", "citation_index"], "left")
    return joined.withColumns({n: F.coalesce(n, v) for n, v in empty.items()}).select(*FEATURE_COLUMNS)
