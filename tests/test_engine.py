"""Operators on hand-written rows that the provided tables lack."""

from functools import reduce
from operator import add

from pyspark.sql import Row
from pyspark.sql import functions as F

from quellwerk.functions import text as X
from quellwerk.operators import analytics as A
from quellwerk.operators import html as H
from quellwerk.operators import records as R
from quellwerk.plans.report import markdown_table
from quellwerk.sources import readers
from quellwerk.streaming.ingest import ingest_records, refresh_cache


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_url_functions(spark):
    url = "https://www.News.google.com:80/a-b/what_is/?q=1#z"
    assert one(spark, X.feature_domain(F.col("u")), u=url) == "news.google.com:80"
    assert one(spark, X.search_domain(F.col("u")), u=url) == "news.google.com"
    assert one(spark, X.path_depth(F.col("u")), u=url) == 2
    assert one(spark, X.url_keyword(F.col("u"), F.array(F.lit("what"))), u=url) is True
    assert one(spark, X.display_name(F.col("u")), u="") == "unknown"
    assert [one(spark, X.domain_type(F.col("u")), u=h) for h in ("x.gov", "cdc.nih.gov", "my.education", "shop.com")] == ["government", "government", "academic", "commercial"]


def test_text_functions(spark):
    assert one(spark, X.tokens(F.col("t")), t="Äpfel und 中文字 a") == ["pfel", "und", "中文字"]
    assert one(spark, X.language(F.col("t")), t="中文字 ab") == "zh"
    assert one(spark, X.squeeze(F.col("t")), t="　a  b\n") == "a b"
    assert one(spark, X.ngrams(F.split("t", " "), 2), t="a") == []
    assert one(spark, X.ngrams(F.split("t", " "), 2), t="a b c") == ["a b", "b c"]
    assert [one(spark, X.number(F.col("t")), t=t) for t in ("-", "1d", "nan", " 2.5 ")] == [None, None, None, 2.5]
    flags = spark.createDataFrame([("How to do it: step 1, 5 % vs. 3\nx?\n",)], "t string").select(*[f.alias(n) for n, f in X.content_flags(F.col("t")).items()]).first()
    assert flags.asDict() == {"has_numbers": True, "has_definition": False, "has_qa_format": True, "has_howto": True, "has_comparison": True}


def test_error_class(spark):
    rows = spark.createDataFrame([("SSLError connection pool", None, ""), (None, 503, ""), (None, 200, "Just a moment"), ("odd", 200, ""), (None, 200, "fine")], "e string, s int, b string")
    assert [r.c for r in rows.select(X.error_class(F.col("e"), F.col("s"), F.col("b")).alias("c")).collect()] == ["connection", "server_error", "js_challenge", "unknown", ""]


def test_html(spark):
    page = "<title>T</title><script>no</script><h2>H</h2><ul><li><p>a b<a href='/x?q'>c</a><li>d</ul><pre><code>k</code></pre><img src=i><table></table><template>t</template>"
    got = H.parse_pages(spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert got[0].text == "T H a b c d k" and got[0].title == "T" and got[0].headings == [0, 1, 0, 0, 0, 0]
    assert (got[0].paragraphs, got[0].lists, got[0].items, got[0].tables, got[0].images, got[0].codes) == (1, 1, 2, 1, 1, 2)
    assert sorted(b.end - b.start for b in got[0].blocks) == [0, 1, 1] and got[0].paragraph_words == [0]
    assert got[1].text == got[2].text == ""


def test_long_pages_are_parsed_whole(spark):
    rows = spark.range(1).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>a</p><!--"), F.repeat(F.lit("x"), 5_000_000), F.lit("--><p>b</p>")).alias("html"))
    assert [(r.paragraphs, r.text) for r in H.parse_pages(rows).collect()] == [(2, "a b")]
    assert [r.text for r in H.parse_pages(rows, most_chars=8).collect()] == ["a"]


def test_link_influence_ignores_empty_url(spark):
    rows = spark.createDataFrame([(1, ["/a", "/b?x"], "/b"), (1, ["/a"], "")], "k int, links array<string>, url string")
    assert [(r.ref_count, r.first_position_ratio) for r in R.link_influence(rows, ["k"], "links", "url").collect()] == [(1, 0.5), (0, 1.0)]


def test_ranks_with_ties(spark):
    rows = spark.createDataFrame([("r", i, s, c, d) for i, s, c, d in [(0, 0.5, 1, "x"), (1, 0.5, 1, "x"), (2, 0.9, 3, "y")]], "rec string, i int, score double, refs int, domain string")
    got = {r.i: (r.influence_rank, r.rank_by_ref_count, r.same_domain_count, r.domain_is_unique) for r in R.with_ranks(rows, "rec", "score", "refs", "domain", "i").collect()}
    assert got == {0: (2, 2, 2, False), 1: (3, 2, 2, False), 2: (1, 1, 1, True)}


def test_labels(spark):
    rows = spark.createDataFrame([(1, '```json\n[{"idx":0,"semantic_role":"a"},{"idx":0,"semantic_role":"b","relevance_score":3},5]\n```'), (2, "broken")], "k int, t string")
    got = R.labels_by_index(rows, ["k"], "t").collect()
    assert [(r.k, r.citation_index, r.llm_semantic_role, r.llm_relevance_score, r.llm_influence_type) for r in got] == [(1, 0, "b", 3, "")]


def test_correlation_guards(spark):
    rows = spark.range(30).select(F.lit(1.0).alias("flat"), F.col("id").cast("double").alias("x"), (F.col("id") * 2).alias("y"))
    assert [(r.feature, round(r.r, 9)) for r in A.correlation_rank(rows, "y", ["flat", "x"]).collect()] == [("x", 1.0)]
    assert A.correlation_rank(rows.limit(29), "y", ["x"]).count() == 0


def test_csv_round_trip(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_bytes('﻿文件名,t\nA1,"x,\n""y"""\n文件名,t\nA2,null\n'.encode())
    rows = readers.clean_header_rows(readers.read_csv(spark, str(source), ["文件名", "t"]), "文件名").collect()
    assert [tuple(r) for r in rows] == [("A1", 'x,\n"y"'), ("A2", None)]
    kept = readers.read_csv(spark, str(source), ["文件名", "t"], na=False).collect()
    assert kept[-1].t == "null"


def test_records_stream_and_cache(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"source_file":"a","citations":[{"url":"u"}]}\nbroken\n{"source_file":"b"}\n'
    (tmp_path / "in" / "1.jsonl").write_text(line)
    assert [r.source_file for r in readers.read_records(spark, str(tmp_path / "in"), lines=True).collect()] == ["a"]
    run = lambda: ingest_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.select("source_file"))
    run(), run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    cache = spark.createDataFrame([("u1", ""), ("u2", "timeout")], "url string, fetch_error string")
    fresh = refresh_cache(spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string"), cache, lambda d: d.select("url", F.lit("").alias("fetch_error")))
    assert sorted(tuple(r) for r in fresh.collect()) == [("u1", ""), ("u2", ""), ("u3", "")]


def test_pair_files_and_prompts(spark):
    files = spark.createDataFrame([("/d/x_0_001_a.html",), ("/d/y_1_002_b.html",), ("/d/x_1_001_a.html",)], "path string")
    assert [r.pair_path for r in readers.pair_files(files).collect()] == ["/d/x_1_001_a.html"]
    prompts = R.prompt_lines(spark.createDataFrame([("promptB.txt", "one\ntwo")], "name string, value string"))
    rows = spark.createDataFrame([("B", 2), ("B", 0), ("B", 9)], "layer string, n long")
    assert sorted(r.prompt for r in R.attach_prompt(rows, prompts, "layer", "n").collect()) == ["", "", "two"]


def test_markdown(spark):
    assert markdown_table(spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z int")) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | 0.5 | - |"


def test_means_are_taken_row_by_row(spark):
    rows = spark.createDataFrame([("a", 0.1)] * 10 + [("a", float("nan")), ("a", None), ("b", None)], "k string, x double").coalesce(1)
    added = reduce(add, [0.1] * 10) / 10  # sum() would compensate
    assert added != 0.1
    assert [tuple(r)[:3] for r in A.summary(rows, ["x"]).collect()] == [("x", 10, added)]
    assert [tuple(r)[:3] for r in A.category_mean(rows, "k", "x", 1).collect()] == [("a", 10, added)]
    assert [tuple(r)[:3] for r in A.score_stats(rows, "k", "x").collect()] == [("a", 10, added)]
    assert A.summary(rows.filter("k = 'c'"), ["x"]).first().asDict() == {"feature": "x", "n": 0} | dict.fromkeys(["mean", "p10", "p25", "median", "p75", "p90", "min", "max"], 0.0)
