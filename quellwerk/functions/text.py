"""Text and URL functions on columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quellwerk.functions import constants as K


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more Latin letters or CJK signs."""
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN), F.lit(0))


def bound(value: Column, f) -> Column:
    """f of the value, which is computed once however often f uses it, also within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space; none if there are fewer."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bound(words, lambda w: F.when(F.size(w) >= n, grams(w)).otherwise(F.array().cast("array<string>")))


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{K.SPACE}+", " "), r"^ | $", "")


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, f"^{K.SPACE}+|{K.SPACE}+$", "")


def strip_badge(name: Column) -> Column:
    """Without a trailing +N."""
    return F.trim(F.regexp_replace(name, r"\+\d+$", ""))


def record_id(source: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(source, 256), 1, 16)


def info_density(text: Column) -> Column:
    """The share of words beyond the stop list and longer than 2."""
    useful = lambda words: F.size(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(K.STOP_WORDS)))
    return bound(F.regexp_extract_all(F.lower(text), F.lit(K.INK), F.lit(0)), lambda words: F.round(useful(words) / F.greatest(F.size(words), F.lit(1)), 3))


def language(text: Column) -> Column:
    """Zh if more than 0.3 of Latin and CJK signs are CJK, else en."""
    cjk, latin = F.regexp_count(text, F.lit("[一-鿿]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when(cjk / F.greatest(cjk + latin, F.lit(1)) > 0.3, "zh").otherwise("en")


def sentence_length(text: Column) -> Column:
    """Mean words of the sentences longer than 5 characters."""
    words = lambda parts: F.aggregate(parts, F.lit(0), lambda n, s: n + F.regexp_count(s, F.lit(K.INK)))
    parts = F.filter(F.transform(F.split(text, "[.!?。！？]+"), strip), lambda s: F.length(s) > 5)
    return bound(parts, lambda p: F.round(F.when(F.size(p) > 0, words(p) / F.size(p)).otherwise(0.0), 1))


def unique_ratio(text: Column) -> Column:
    """Distinct words over words."""
    return bound(F.regexp_extract_all(F.lower(text), F.lit(K.WORD), F.lit(0)), lambda words: F.round(F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)), 4))


def overlap(wanted: Column, given: Column, digits: int) -> Column:
    """The share of distinct wanted terms that are given; 0 if none is wanted."""
    share = lambda w: F.size(F.array_intersect(w, given)) / F.size(w)
    return bound(F.array_distinct(wanted), lambda w: F.round(F.when(F.size(w) > 0, share(w)).otherwise(0.0), digits))


def content_flags(text: Column) -> dict[str, Column]:
    """T21 to T25."""
    flags = {"has_numbers": K.HAS_NUMBERS, "has_definition": K.HAS_DEFINITION, "has_qa_format": K.HAS_QA, "has_howto": K.HAS_HOWTO, "has_comparison": K.HAS_COMPARISON}
    return {name: text.rlike(pattern) for name, pattern in flags.items()}


def first_rule(rules, holds, otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = None
    for pattern, label in rules:
        out = F.when(holds(pattern), label) if out is None else out.when(holds(pattern), label)
    return out.otherwise(otherwise)


def question_type(question: Column) -> Column:
    """T13, J14."""
    q = F.lower(strip(question))
    return first_rule(K.QUESTION_RULES, lambda rule: q.rlike(f"(?U){rule}"), "other")


def domain_type(host: Column) -> Column:
    """T12, J13."""
    h = F.lower(host)
    return first_rule(K.DOMAIN_RULES, h.contains, "commercial")


def netloc(url: Column) -> Column:
    """Lower-cased host and port; never fails on odd urls."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def feature_domain(url: Column) -> Column:
    """Every www. removed, the port kept."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def tld(host: Column) -> Column:
    """T08."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def path_depth(url: Column) -> Column:
    """T09."""
    return F.size(F.filter(F.split(url_path(url), "/"), lambda p: p != ""))


def url_keyword(url: Column, question_tokens: Column) -> Column:
    """Whether the path has a token of the question."""
    path = F.translate(F.lower(url_path(url)), "-_", "  ")
    return F.coalesce(F.arrays_overlap(F.regexp_extract_all(path, F.lit("[a-z]{3,}"), F.lit(0)), question_tokens), F.lit(False))


def search_domain(url: Column) -> Column:
    """Without www. and port, null unless it looks like a domain."""
    host = F.regexp_replace(F.replace(netloc(url), F.lit("www."), F.lit("")), r":.*$", "")
    return F.when(host.rlike(r"^[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"), host)


def display_name(url: Column) -> Column:
    """The host without a leading www., or unknown."""
    host = F.regexp_replace(netloc(url), r"^www\.", "")
    return F.when(host == "", "unknown").otherwise(host)


def is_block_page(body: Column) -> Column:
    """A block page's sign among the first 4096 characters."""
    head = F.lower(F.substring(body, 1, 4096))
    return F.exists(F.array(*[F.lit(s) for s in K.BLOCK_PAGE_SIGNS]), head.contains)


def error_class(exception: Column, status: Column, snippet: Column) -> Column:
    """By exception text, then status, then block-page sign."""
    raised = F.coalesce(exception, F.lit("")) != ""
    text = F.lower(exception)
    out = F.when(F.lit(False), "")
    for signs, label in K.EXCEPTION_RULES:
        hit = F.lit(False)
        for s in signs:
            hit = hit | text.contains(s)
        out = out.when(raised & hit, label)
    out = out.when(status == 403, "forbidden").when(status == 404, "not_found").when(status == 429, "rate_limited").when(status >= 500, "server_error")
    return out.when(is_block_page(F.coalesce(snippet, F.lit(""))), "js_challenge").when(raised, "unknown").otherwise("")


def strip_tags(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    return F.regexp_replace(html, K.TAGS, " ")


def number(text: Column) -> Column:
    """A number, or null for anything else."""
    return F.when(text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))


def truthy(text: Column) -> Column:
    """S07, T36."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


def influence_score(refs: Column, position: Column, coverage: Column, tfidf: Column, bigram: Column, trigram: Column) -> Column:
    """M04, over inputs that are rounded already."""
    a, b, c, d, e = K.SCORE_WEIGHTS
    return F.round(a * F.least(refs / 3.0, F.lit(1.0)) + b * (1 - position) + c * coverage + d * tfidf + e * (bigram + trigram) / 2, 4)


def cosine(a: Column, b: Column) -> Column:
    """0 for missing or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def prefixed_category(name: Column) -> Column:
    """Joins the two industry prefixes that lack their underscore."""
    return F.regexp_replace(name, "^A(news|technology)", "A_$1")


def style_label(n: Column) -> Column:
    """P10: by remainder of 3."""
    return F.when(n % 3 == 1, "natural").when(n % 3 == 2, "source").otherwise("role")


def scenario_label(n: Column) -> Column:
    """By tens of 1 to 50."""
    out = F.when(n.between(1, 10), "high_risk")
    for low, label in ((11, "vague"), (21, "multi_constraint"), (31, "long_decision"), (41, "macro_trend")):
        out = out.when(n.between(low, low + 9), label)
    return out.otherwise("unknown")


def infer_category(path: Column) -> Column:
    """The first part of a path that names a category, else the empty text."""
    return F.coalesce(F.get(F.filter(F.split(path, r"[/\\]"), lambda p: p.rlike(K.CATEGORY_PART)), F.lit(0)), F.lit(""))


def clip(text: Column, most_chars: int) -> Column:
    """The first most_chars characters."""
    return F.substring(text, 1, most_chars)


def clip_tokens(text: Column, most_tokens: int = 8100, chars_a_token: int = 3) -> Column:
    """As many characters as most_tokens have, by the given mean; no tokenizer is needed."""
    return clip(text, most_tokens * chars_a_token)


def tech_text(techs: Column) -> Column:
    """A map of names to structs with a category as "name [category] | ...", on one line."""
    parts = F.transform(F.map_entries(techs), lambda e: F.concat(e["key"], F.lit(" ["), F.coalesce(e["value"]["category"], F.lit("null")), F.lit("]")))
    return F.coalesce(F.nullif(F.array_join(one_line(parts), " | "), F.lit("")), F.lit("null"))


def one_line(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.translate(p, "\n\r", "  "))


def _runs(terms: Column) -> Column:
    """(n, term, a, c) per distinct term of a sorted array of (term, side): how often it occurs, in
    all, on side 0 and on side 1. One pass over the sorted array."""
    first = lambda t: F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i == 0) | (i == F.size(t)) | (F.get(t, i)["term"] != F.get(t, i - 1)["term"]))

    def run(t: Column, at: Column, end: Column) -> Column:
        own = F.slice(t, at + 1, end - at)
        a = F.size(F.filter(own, lambda x: x["side"] == 0))
        return F.struct((at - end).alias("n"), F.get(t, at)["term"].alias("term"), a.cast("double").alias("a"), (end - at - a).cast("double").alias("c"))

    return bound(terms, lambda t: bound(first(t), lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda at, k: run(t, at, F.get(s, k + 1)))))


#: Smoothed idf over two texts: 1 for a shared term, 1 + ln 1.5 for one of a single text.
IDF_ONE = 1.4054651081081644
MOST_TERMS = 5000


def tfidf_cosine(left: Column, right: Column, stop_words: list[str] = K.STOP_WORDS, most_terms: int = MOST_TERMS) -> Column:
    """The cosine of the TF-IDF vectors of two texts, the vectoriser being fitted on just them;
    of all terms the most_terms most frequent count, by code point where they tie. stop_words are
    left out; the default is the list of the information density. Terms are counted in the row."""
    side = lambda text, k: F.transform(F.filter(F.regexp_extract_all(F.lower(text), F.lit(K.TERM), F.lit(0)), lambda w: ~w.isin(stop_words)), lambda w: F.struct(w.alias("term"), F.lit(k).alias("side")))
    both = F.array_sort(F.concat(side(left, 0), side(right, 1)))
    kept = bound(_runs(both), lambda r: F.when(F.size(r) > most_terms, F.slice(F.array_sort(r), 1, most_terms)).otherwise(r))
    idf2 = lambda r: F.when((r["a"] > 0) & (r["c"] > 0), 1.0).otherwise(IDF_ONE**2)
    zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("na"), F.lit(0.0).alias("nc"))
    add = lambda s, r: F.struct((s["dot"] + r["a"] * r["c"]).alias("dot"), (s["na"] + r["a"] * r["a"] * idf2(r)).alias("na"), (s["nc"] + r["c"] * r["c"] * idf2(r)).alias("nc"))
    cosine = F.aggregate(kept, zero, add, lambda s: F.try_divide(s["dot"], F.sqrt(s["na"]) * F.sqrt(s["nc"])))
    return F.round(F.coalesce(cosine, F.lit(0.0)), 4)
