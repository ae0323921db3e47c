"""The influence report: named tables over the feature table, rendered as Markdown and as one HTML file."""

from __future__ import annotations

import base64
import html
import mimetypes
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.operators import analytics as A
from quellwerk.operators import features as V

#: Edges of the length classes, in words.
LENGTHS = [0, 100, 300, 600, 1000, 3000]
TYPE_FLAGS = ["cit_has_numbers", "cit_has_definition", "cit_has_qa_format", "cit_has_howto", "cit_has_comparison", "cit_has_code"]
LENGTH_COLUMNS = ["cit_word_count", "cit_char_count", "cit_info_density", "cit_unique_word_ratio", "cit_avg_sentence_length"]
PAGE_COLUMNS = [c for c in V.CONTENT_NUMERIC if c not in LENGTH_COLUMNS and not c.startswith("cit_heading_h") and c != "title_question_match"]
MODEL_NUMERIC = ["emb_answer_cit_cosine", "emb_question_cit_cosine", "llm_relevance_score", "llm_content_quality"]
CONTENT = [*PAGE_COLUMNS, *LENGTH_COLUMNS, "title_question_match", *MODEL_NUMERIC]
SCORE = "influence_score"


# --- rendering -------------------------------------------------------------------------------


def percent(part: float, whole: float) -> str:
    """T38."""
    return f"{100 * part / whole:.2f}%" if whole else "0.00%"


def cell(value) -> str:
    if value is None:
        return "-"
    return f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value).replace("|", "\\|")


def markdown_table(table: DataFrame, most_rows: int = 200) -> str:
    """A result table as Markdown, of at most most_rows rows."""
    rows = table.limit(most_rows).collect()
    lines = ["| " + " | ".join(table.columns) + " |", "| " + " | ".join("---" for _ in table.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def markdown_report(title: str, sections: list[tuple[str, DataFrame]]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(table)}" for name, table in sections)]) + "\n"


# --- tables ----------------------------------------------------------------------------------


def fetched(features: DataFrame) -> DataFrame:
    """Citations whose page is known; all influence figures are of these."""
    return features.filter("fetch_ok")


def platform_overview(features: DataFrame) -> DataFrame:
    """Per platform the citations, their share, those fetched and the rate of fetching."""
    counted = features.groupBy("platform").agg(F.count(F.lit(1)).alias("total"), F.count_if("fetch_ok").alias("fetched"))
    share = 100 * F.col("total") / F.sum("total").over(A.Window.partitionBy())
    return counted.select("platform", "total", share.alias("share"), "fetched", (100 * F.col("fetched") / F.col("total")).alias("fetch_rate"))


def preview(rows: DataFrame, order: list, k: int = 5) -> DataFrame:
    """The first rows."""
    return rows.orderBy(*order).limit(k)


def influence_tables(features: DataFrame) -> list[tuple[str, DataFrame]]:
    """The report's tables. features is read by each; pass it materialised."""
    f = fetched(features)
    labelled = f.filter("llm_influence_type <> ''")
    flag_shares = A.top_bottom(f, SCORE, TYPE_FLAGS)
    return [
        ("1.1 Size", features.agg(F.count(F.lit(1)).alias("citations"), F.count_distinct("record_id").alias("records"), F.count_distinct("domain").alias("domains"), F.count_if("fetch_ok").alias("fetched"))),
        ("1.2 Platforms", platform_overview(features).orderBy(F.col("total").desc(), "platform")),
        ("1.3 Categories", A.distribution(features.withColumn("category", F.nullif(F.col("category"), F.lit(""))), "category")),
        ("2.1 Length of cited pages", A.summary(f, LENGTH_COLUMNS)),
        ("2.2 Structure of cited pages", A.summary(f, PAGE_COLUMNS)),
        ("2.3 Kinds of contents", A.prevalence(f, TYPE_FLAGS)),
        ("2.4 Kinds of sources", A.top_k(A.distribution(f, "domain_type"), 15, [F.col("n").desc(), F.col("value")])),
        ("3.1 Structure and influence", strength(A.correlation_rank(f, SCORE, PAGE_COLUMNS, p=True))),
        ("3.2 Length, quality and influence", strength(A.correlation_rank(f, SCORE, LENGTH_COLUMNS, p=True))),
        ("3.3 Kinds of contents and influence", A.boolean_lift(f, TYPE_FLAGS, SCORE).orderBy(F.abs("delta").desc(), "feature")),
        ("3.4 Meaning and influence", strength(A.correlation_rank(f, SCORE, ["title_question_match", *MODEL_NUMERIC], p=True))),
        ("3.5 All features by correlation", strength(A.correlation_rank(f, SCORE, CONTENT, top=20, p=True))),
        ("4.1 Top and bottom fifth", A.top_bottom(f, SCORE, CONTENT).orderBy(F.abs(F.round("delta", 9)).desc_nulls_last(), "feature")),
        ("4.2 Kinds of contents in the top and bottom fifth", flag_shares.orderBy(F.abs("delta").desc_nulls_last(), "feature")),
        ("4.3 Influence by length", A.binned(f, "cit_word_count", SCORE, LENGTHS).orderBy("bin")),
        ("5.1 Roles", A.category_mean(f.filter("llm_semantic_role <> ''"), "llm_semantic_role", SCORE).orderBy(F.col("mean").desc(), "category")),
        ("5.1 Roles in the top and bottom fifth", A.distribution_compare(f.filter("llm_semantic_role <> ''"), SCORE, "llm_semantic_role")),
        ("5.2 Paraphrased and merely named sources", A.type_profile(labelled, "llm_influence_type", [*CONTENT, *TYPE_FLAGS], "paraphrase", "reference")),
        ("5.3 Sources", A.category_mean(f, "domain_type", SCORE).orderBy(F.col("mean").desc(), "category")),
        ("5.4 Rated quality", A.category_mean(f.filter("llm_content_quality > 0"), "llm_content_quality", SCORE).orderBy("category")),
        ("6.1 Scores by platform", A.score_stats(f, "platform", SCORE).orderBy("platform")),
        ("6.2 What drives each platform", A.correlation_rank(f, SCORE, CONTENT, top=8, by=["platform"]).orderBy("platform", F.abs("r").desc(), "feature")),
        ("6.3 Roles by platform", A.top_k(A.share_within(f.filter("llm_semantic_role <> ''"), ["platform"], "llm_semantic_role"), 8, [F.col("n").desc(), F.col("llm_semantic_role")], ["platform"])),
        ("7.1 Categories", A.slice_drivers(f.filter("category <> ''"), "category", SCORE, CONTENT).orderBy(F.col("rows").desc(), "category", F.abs("delta").desc(), "feature")),
        ("7.2 Kinds of questions", A.slice_drivers(f, "question_type", SCORE, CONTENT).orderBy(F.col("rows").desc(), "question_type", F.abs("delta").desc(), "feature")),
    ]


def strength(ranking: DataFrame) -> DataFrame:
    """T37 beside r."""
    return ranking.withColumn("strength", A.correlation_words(F.col("r"))).orderBy(F.abs(F.round("r", 9)).desc(), "feature")


def influence_report(features: DataFrame) -> str:
    """The report as Markdown. Every table is a result of bounded size."""
    return markdown_report("What makes sources influential in answers", influence_tables(features))


# --- one HTML file -----------------------------------------------------------------------------


def data_uri(file: Path) -> str:
    kind = mimetypes.guess_type(file.name)[0] or "application/octet-stream"
    return f"data:{kind};base64,{base64.b64encode(file.read_bytes()).decode()}"


def inline_images(markdown: str, folder: Path) -> tuple[str, list[str]]:
    """Local images as data URIs, and the references that name no file below folder."""
    missing: list[str] = []
    base = folder.resolve()

    def uri(match: re.Match[str]) -> str:
        before, ref, after = match.groups()
        if re.match(r"(?:https?:|data:|#)", ref):
            return match[0]
        file = (base / ref.lstrip("/")).resolve()
        if not (file.is_file() and file.is_relative_to(base)):
            missing.append(ref)
            return match[0]
        return f"{before}{data_uri(file)}{after}"

    shown = re.sub(r"(!\[[^\]]*\]\()([^)\s]+)(\))", uri, markdown)
    return re.sub(r'(?i)(\bsrc\s*=\s*")([^"]+)(")', uri, shown), missing


def _inline(text: str) -> str:
    text = html.escape(text, quote=False)
    for pattern, shown in ((r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img alt="\1" src="\2">'), (r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>'), (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"`([^`]+)`", r"<code>\1</code>")):
        text = re.sub(pattern, shown, text)
    return text


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def render_markdown(markdown: str) -> str:
    """Headings, tables, lists and paragraphs; a table sits in a box that scrolls."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", markdown.strip()):
        lines = block.split("\n")
        if match := re.match(r"(#{1,6}) (.*)", lines[0]):
            out.append(f"<h{len(match[1])}>{_inline(match[2])}</h{len(match[1])}>")
            lines = lines[1:]
        if len(lines) > 1 and lines[0].startswith("|") and set(lines[1]) <= set("|-: "):
            row = lambda line, tag: "<tr>" + "".join(f"<{tag}>{_inline(c)}</{tag}>" for c in _cells(line)) + "</tr>"
            out.append('<div class="table-wrap"><table>' + row(lines[0], "th") + "".join(row(x, "td") for x in lines[2:]) + "</table></div>")
        elif lines and all(x.startswith("- ") for x in lines):
            out.append("<ul>" + "".join(f"<li>{_inline(x[2:])}</li>" for x in lines) + "</ul>")
        elif lines:
            out.append(f"<p>{_inline(' '.join(lines))}</p>")
    return "\n".join(out)


def self_contained_html(markdown: str, folder: Path, title: str = "Report") -> tuple[str, list[str]]:
    """One HTML file that needs no other, and the images that were not found."""
    shown, missing = inline_images(markdown, folder)
    style = "body{max-width:60em;margin:auto;font-family:sans-serif}.table-wrap{overflow-x:auto}td,th{padding:.2em .6em;border:1px solid #ccc}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body>{render_markdown(shown)}</body></html>', missing
