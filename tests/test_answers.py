"""Platform pages, fetching, the search layer's edge cases, the report."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quellwerk.functions import text as X
from quellwerk.operators import analytics as A
from quellwerk.operators import answers, features
from quellwerk.operators import html as H
from quellwerk.operators import records as R
from quellwerk.operators import search as L
from quellwerk.operators import similarity as S
from quellwerk.plans import report
from quellwerk.sources import fetching, readers

CHATGPT = """<html><title> Chat
 one</title><div data-turn="user"><div data-message-author-role="user">You said: <p>What is  x?</p> ChatGPT said: no</div></div>
<div data-turn="assistant"><a href="http://early.com">e</a><div class="a markdown b"><p>It &lt; is<br><b>x</b></p></div>
<span data-testid="webpage-citation-pill"><a href=" https://one.com/p?x ">One <i>News</i>+2</a></span>
<span data-testid="webpage-citation-pill"><a href="https://one.com/p?x">Again</a><a href="https://chatgpt.com/c/1">own</a><a href="https://www.two.com/"></a><a href="/rel">r</a></span></div></html>"""
GOOGLE = """<title>best phone - Google Search</title><div class="mZJni"><!--c--><span>s</span><div>Answer<!-- gone --> <b>text</b></div></div>
<a class="x NDNGvf" href="https://a.com/1" aria-label="Title - Part - Source A. Opens in new tab.">z</a><a class="NDNGvf" href="https://maps.google.com/x">m</a>
<a class="NDNGvf" href="https://www.b.com/">z</a><a class="NDNGvf" href="https://c.com/" aria-label="Only">z</a>"""
PERPLEXITY = '<h1 class="group/query other">Why  so?</h1><div class="prose"><div data-renderer="lm"><p>Because</p></div></div><span class="citation inline">Site+3</span><span class="citation inline"> </span>'
PAIR = '<a class="gap-sm" href="https://s.org/1"><b>no</b>https://s.org Site S</a><a class="gap-sm" href="https://t.org/1"> Site T <b>x</b></a><a class="gap-sm" href="https://www.perplexity.ai/x">p</a>'


def test_chatgpt_page():
    got = answers.read_answer(answers.CHATGPT, CHATGPT)
    assert got["title"] == "Chat one" and got["question"] == "What is x?"
    assert got["answer_html"] == "<p>It &lt; is<br/><b>x</b></p>"
    assert got["citations"] == [{"url": "https://one.com/p?x", "display_name": "One News"}, {"url": "https://www.two.com/", "display_name": "two.com"}]
    plain = answers.read_answer(answers.CHATGPT, '<p>You said: a <b>b</b> ChatGPT said:</p><p data-start="1">x</p><p>y</p><p data-start="2">z</p><a href="http://q.com/cdn/assets/1">c</a>')
    assert plain["question"] == "a b" and plain["answer_html"] == '<p data-start="1">x</p><p data-start="2">z</p>' and plain["citations"] == []


def test_google_page():
    got = answers.read_answer(answers.GOOGLE, GOOGLE)
    assert got["question"] == "best phone" and got["answer_html"] == "Answer <b>text</b>"
    assert [c["display_name"] for c in got["citations"]] == ["Source A", "b.com", "Only"]
    assert answers.read_answer(answers.GOOGLE, '<div><ul class="KsbFXc"><li>1</ul>t</div>')["answer_html"] == '<ul class="KsbFXc"><li>1</li></ul>t'
    assert answers.read_answer(answers.GOOGLE, '<li class="dF3vjf">1<li class="dF3vjf">2')["answer_html"] == '<li class="dF3vjf">1</li><li class="dF3vjf">2</li>'


def test_perplexity_pages(spark):
    files = spark.createDataFrame([("/d/x_0_001_a.html", PERPLEXITY), ("/d/x_1_001_a.html", PAIR), ("/e/y_0_002_b.html", PERPLEXITY), ("/e/other.html", "")], "path string, html string")
    got = {r.source_file: r for r in answers.parse_answers(answers.paired_files(files), "perplexity").collect()}
    assert set(got) == {"/d/x_0_001_a.html", "/e/y_0_002_b.html"}
    first, second = got["/d/x_0_001_a.html"], got["/e/y_0_002_b.html"]
    assert first.question == "Why so?" and first.answer_html == "<p>Because</p>" and first.pair_file == "/d/x_1_001_a.html"
    assert [tuple(c) for c in first.citations] == [("https://s.org/1", "s.org"), ("https://t.org/1", "Site T")]
    assert [tuple(c) for c in second.citations] == [("", "Site")] and second.pair_file == ""


def test_registry_reads_null_and_broken_pages(spark):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "<" * 50 + "a href"), ("d", "<div>" * 30_000)], "path string, html string")
    for platform in ("chatgpt", "google"):
        got = answers.parse_answers(files, platform).collect()
        assert len(got) == 4 and all(r.parse_error is None and r.citations == [] for r in got)


def test_malformed_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 50_000, "<h3>" * 20_000 + "<a href=x>" * 20_000, "<p><div>" + "<b>" * 50_000 + "<p>x</p>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000):
        H.parse(page)
    assert time.perf_counter() - began < 8


def test_page_words_and_blocks():
    got = H.parse("<p>one two, x 中文字<ul><li><a href='/a'>three</a><p>four <a href>five</a></ul><h3><a href='/b' href='/c'>t</a></h3><ruby>a<rt>b</rt></ruby>")
    assert got["links"] == ["/a", "", "/b"] and got["text"] == "one two, x 中文字 three four five t a"
    assert sorted((b["start"], b["end"]) for b in got["blocks"]) == [(0, 3), (0, 2), (1, 2), (2, 3)] or sorted((b["start"], b["end"]) for b in got["blocks"]) == [(0, 2), (0, 3), (1, 2), (2, 3)]


def test_mean_words_of_a_paragraph(spark):
    rows = spark.createDataFrame([(1, "<p>one two three</p><p>four, a b</p>"), (2, "")], "page_id long, html string")
    got = {r.page_id: r for r in H.structure(H.parse_pages(rows)).collect()}
    assert got[1].avg_para_words == 2.0 and got[2].avg_para_words == 0.0 and got[1].heading_h1 == 0


def test_features_of_edge_records(spark):
    cite = {"url": "http://a.com/x", "display_name": "A", "title": "T", "fetched_html": "<p>same words here</p>", "fetch_error": ""}
    records = [
        Row(source_file="d/A_news/1.html", platform="g", category=None, question="same words?", answer_html="<p>same words here <a href='http://a.com/x?y'>l</a></p>", citations=[cite, cite | {"url": ""}, cite | {"fetched_html": "", "fetch_error": "timeout"}]),
        Row(source_file="", platform="g", category="B1", question="", answer_html="", citations=[cite]),
        Row(source_file=None, platform="p", category="", question=None, answer_html=None, citations=[cite]),
        Row(source_file="z", platform="p", category="", question="q", answer_html="x", citations=[]),
    ]
    schema = "source_file string, platform string, category string, question string, answer_html string, citations array<" + readers.CITATION + ">"
    full = [r.asDict() | {"citations": [c | {"final_url": "", "status_code": 200, "fetched_html_path": "", "error_class": "", "body_snippet": "", "attempts": 1} for c in r.citations]} for r in records]
    order = [f.split(" ")[0] for f in readers.CITATION.removeprefix("struct<").removesuffix(">").split(", ")]
    rows = spark.createDataFrame([tuple([tuple(c[n] for n in order) for c in v] if k == "citations" else v for k, v in r.items()) for r in full], schema)
    found = features.features(rows)
    assert found.columns == features.FEATURE_COLUMNS and len(found.columns) == 72
    got = found.orderBy("question_type", "record_id", "citation_index").collect()
    assert len(got) == 5 and len({r.record_id for r in got}) == 3
    assert all(v is not None for r in got for k, v in r.asDict().items() if k != "status_code")
    main = {r.citation_index: r for r in got if r.category == "A_news"}
    assert (main[0].ref_count, main[0].covered_paragraphs, main[0].paragraph_coverage_ratio, main[0].influence_rank) == (1, 1, 1.0, 1)
    assert (main[1].ref_count, main[1].first_position_ratio) == (0, 1.0) and (main[2].fetch_ok, main[2].cit_word_count, main[2].cit_language) == (False, 0, "")
    strict = features.features(rows, strict=True).filter("category = 'A_news' and url = ''").first()
    assert strict.ref_count == 1 and strict.first_position_ratio == 0.0


def test_page_bodies_move_out_and_back(spark):
    cite = F.struct(F.lit("http://a").alias("url"), F.lit("<p>body</p>").alias("fetched_html"), F.lit(None).cast("string").alias("fetched_html_path"), F.lit("").alias("fetch_error"))
    none = F.struct(F.lit("http://b").alias("url"), F.lit("").alias("fetched_html"), F.lit(None).cast("string").alias("fetched_html_path"), F.lit("").alias("fetch_error"))
    index, bodies = readers.split_bodies(spark.range(2).select(F.array(cite, none).alias("citations")))
    assert bodies.count() == 1 and index.first().citations[0].fetched_html == "" and index.first().citations[1].fetched_html_path == ""
    rows = index.select(F.explode("citations").alias("citation"))
    assert sorted(r._html for r in features.page_bodies(rows, bodies).collect()) == ["", "", "<p>body</p>", "<p>body</p>"]


def test_unicode_white_space(spark):
    text = "one　two three four. 　five six seven eight　"
    row = spark.createDataFrame([(text, "x　how to fly"), ("　What is it", " which one　")], "t string, q string")
    got = row.select(X.info_density(F.col("t")).alias("d"), X.sentence_length(F.col("t")).alias("s"), X.question_type(F.col("q")).alias("k"), X.question_type(F.col("t")).alias("w")).collect()
    assert got[0].s == 4.0 and got[0].d == 1.0 and got[0].k == "how_to" and got[1].k == "which" and got[1].w == "what_is"


def test_tfidf_counts_in_the_row(spark):
    rows = spark.createDataFrame([("red red blue", "red green the"), ("", "x"), ("the of", "the of"), ("ab", "ab")], "a string, b string")
    got = [r.x for r in rows.select(X.tfidf_cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    idf = 1 + math.log(1.5)
    want = 2 / (math.sqrt(4 + idf**2) * math.sqrt(1 + idf**2))
    assert got == [round(want, 4), 0.0, 0.0, 1.0]
    cut = rows.select(X.tfidf_cosine(F.col("a"), F.col("b"), most_terms=1).alias("x")).first().x
    assert cut == 1.0  # red is the most frequent term, and the only one left
    assert rows.select(X.tfidf_cosine(F.col("a"), F.col("b"), stop_words=["red"]).alias("x")).first().x == 0.0


def test_quantiles_against_percentile(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.round(F.rand(5) * (1 + F.col("id") % 7), 2)).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0), (9, None), (None, float("nan"))], "g long, v double"))
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.quantiles for r in A.quantiles(rows, "v", shares, ["g"]).collect()}
    want = {r.g: r.q for r in rows.filter("not isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("q")).collect()}
    assert set(got) == {0, 1, 2, None} and all(got[k] == pytest.approx(want[k]) for k in got)
    assert A.quantiles(rows.limit(0), "v", [0.5], ["g"]).collect() == [] and A.quantiles(rows, "v", [0.5]).count() == 1


def test_summary_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = {r.feature: tuple(r)[1:] for r in A.summary(empty, ["a", "b"]).collect()}
    assert got == {"a": (0,) + (0.0,) * 8, "b": (1,) + (1.0,) * 8}


@pytest.mark.parametrize(("r", "n", "p"), [(0.5, 10, 0.14111328125), (0.0, 12, 1.0), (1.0, 5, 0.0), (-0.3, 4, 0.7)])
def test_correlation_p(r, n, p):
    if n == 10:  # by integration of the density of r under independence, (1 - r^2)^((n - 4) / 2)
        steps = 200_000
        f = lambda x: (1 - x * x) ** ((n - 4) / 2)
        whole = sum(f(-1 + 2 * (i + 0.5) / steps) for i in range(steps))
        p = sum(f(-1 + 2 * (i + 0.5) / steps) for i in range(steps) if abs(-1 + 2 * (i + 0.5) / steps) >= r) / whole
    assert A.correlation_p(r, n) == pytest.approx(p, abs=1e-4)
    assert A.correlation_p(None, 5) is None and A.correlation_p(0.5, 2) is None


def test_fetching(spark):
    pages = {"http://a/1": [fetching.Response(503, ""), fetching.Response(200, "<title>T</title><p>" + "long text, with words " * 5 + "</p>")], "http://a/2": [fetching.Response(403, "")] * 3}

    def client(url):
        if url == "http://b/3":
            raise TimeoutError("timed out")
        return pages[url].pop(0)

    slept = []
    clock = iter(range(0, 1000))
    f = fetching.Fetcher(client, browser=lambda u: fetching.Response(200, "<p>seen by a browser, which is long enough</p>"), spacing=10, sleep=slept.append, clock=lambda: next(clock))
    one, two, three = (f.fetch(u) for u in ("http://a/1", "http://a/2", "http://b/3"))
    assert (one["title"], one["attempts"], one["error_class"]) == ("T", 2, "") and "long text" in one["fetched_html"]
    assert (two["attempts"], two["error_class"]) == (4, "") and "browser" in two["fetched_html"]
    assert three["attempts"] == 4 and three["error_class"] == "" and any(s > 5 for s in slept)
    assert f.fetch("http://a/2")["error_class"] == "unknown"  # the client has no more replies; no case for the browser
    alone = fetching.Fetcher(lambda u: fetching.Response(404 if u.endswith("x") else 200, "<p>a</p>"), retries=0)
    got = {r.url: r for r in fetching.fetch_urls(spark.createDataFrame([("http://a/x",), ("http://a/y",), ("http://a/y",), ("",)], "url string"), alone).collect()}
    assert {u: r.error_class for u, r in got.items()} == {"http://a/x": "not_found", "http://a/y": ""}


def test_retry_and_backfill(spark):
    cite = "array<struct<url string, title string, fetched_html string, fetch_error string, error_class string, status_code int>>"
    records = spark.createDataFrame([("f", [("http://a/x", "", "", "HTTP 503", "server_error", 503), ("http://a/y", "old", "h", "", "", 200)]), ("g", [])], f"source_file string, citations {cite}")
    failures = spark.createDataFrame([("http://a/x", ["f"], "t1"), ("http://a/x", ["e"], "t0"), ("http://a/z", ["g"], "t0")], "url string, source_files array<string>, timestamp string")
    results, left = fetching.retry_failures(failures, fetching.Fetcher(lambda u: fetching.Response(200 if u.endswith("x") else 404, "<title>New</title>b"), retries=0), when="now")
    got = {r.source_file: r.citations for r in fetching.backfill_citations(records, results).collect()}
    assert [(c.url, c.title, c.fetch_error, c.status_code) for c in got["f"]] == [("http://a/x", "New", "", 200), ("http://a/y", "old", "", 200)] and got["g"] == []
    assert [(r.url, r.error_class, r.prev_timestamp, r.timestamp, r.source_files) for r in left.collect()] == [("http://a/z", "not_found", "t0", "now", ["g"])]


def test_services(spark):
    def api(domain):
        if domain == "bad":
            raise OSError
        return {"good": {"title": "a\nb", "rank": 0}, "odd": ["x"]}.get(domain)

    got = {r.domain: tuple(r)[1:] for r in fetching.enrich(spark.createDataFrame([(d,) for d in ("good", "odd", "none", "bad", "good", None)], "domain string"), "domain", api, ["title", "rank"]).collect()}
    assert got == {"good": ("成功", "a b", "null"), "odd": ("格式异常", "null", "null"), "none": ("无数据", "null", "null"), "bad": ("网络异常", "null", "null")}
    assert fetching.merged_clients(lambda d: {"a": 1}, api, lambda d: {"a": 2, "b": 3})("bad") == {"a": 1, "b": 3}
    types = {r.domain: r.site_type for r in fetching.site_types(spark.createDataFrame([("a",), ("b",)], "domain string"), lambda d: " 官网 " if d == "a" else "long reply").collect()}
    assert types == {"a": "官网", "b": "null"}
    states = iter(["queued", "running", "completed"])
    assert fetching.poll(lambda: next(states), sleep=lambda s: None) == "completed"
    with pytest.raises(RuntimeError):
        fetching.poll(lambda: "queued", most=3, sleep=lambda s: None)
    assert len(fetching.yesterday()) == 10 and fetching.backoff(9, lambda a, b: b) == 45.0


def test_labels_and_embeddings(spark):
    prompts = S.label_prompts(spark.createDataFrame([("r", "q?", "an", 1, "", "u1", "t1"), ("r", "q?", "an", 0, "T0", None, None)], "record_id string, q string, a string, i int, title string, url string, x string"), ["record_id"], "q", "a", "i", "title", "url", "x")
    text = prompts.first().prompt
    assert "Question: q?" in text and text.index("[0] T0 | ") < text.index("[1] N/A | u1\nContent: t1")
    labels = fetching.label_citations(prompts, ["record_id"], lambda p: '```json\n[{"idx": 1, "semantic_role": "evidence"}]\n```', sleep=lambda s: None).collect()
    assert [(r.record_id, r.citation_index, r.llm_semantic_role) for r in labels] == [("r", 1, "evidence")]
    assert fetching.label_citations(prompts, ["record_id"], lambda p: 1 / 0, sleep=lambda s: None).collect() == []
    assert [len(b) for b in S.budgeted(["aaa" * 10] * 5 + ["b" * 300, ""], 20)] == [2, 2, 1, 1, 1]
    vectors = S.embed(S.embedding_texts(spark.createDataFrame([("aa", "b"), ("aa", " "), (None, "cc")], "x string, y string"), ["x", "y"]), lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert sorted(r.embedding[0] for r in vectors.collect()) == [1.0, 2.0, 2.0]


def test_search_layer_edges(spark):
    rows = spark.createDataFrame([("C1", "是", "a.com"), ("C1", None, "b.com"), ("C2", "否", None), ("C3", "是", None), ("C5", None, None), (None, "是", "x"), ("B4", "是", "null")], "name string, triggered string, domain string")
    prompts = L.prompts(L.with_language(rows), ["group", "version"])
    assert {r.name: (r.group, r.version, r.triggered, r.citations) for r in prompts.collect()} == {"C1": (1, "EN", "是", 2), "C2": (1, "ZH", "否", 0), "C3": (2, "EN", "是", 0), "C5": (3, "EN", None, 0)}
    assert sorted(r.group for r in L.divergent_groups(prompts).collect()) == [1, 2, 3]
    names = spark.createDataFrame([("A1",), ("A3",), ("B2",), ("bad",), (None,)], "name string")
    assert sorted((r.prefix, r.missing, r.total) for r in L.missing_total(names).collect()) == [("A", [2], 2), ("B", [1], 2)]
    assert spark.createDataFrame([("b-0af-12_3_x",), ("q",)], "f string").select(L.sequence_of(F.col("f"), 2).alias("s")).collect()[0].s == ["12", "3"]
    links = spark.createDataFrame([("k", " HTTPS://www.A.com:80/x"), ("k", "https://a.com"), ("k", "ftp://b.com"), ("k", "http://google.com/s"), ("k", "http://x")], "k string, u string")
    assert [r.domain for r in answers.dom_domains(links, "k", "u", ["google.com"]).collect()] == ["a.com"]
    techs = spark.createDataFrame([({"R": ("js",), "N": (None,)},), ({},)], "t map<string,struct<category:string>>")
    assert [r.x for r in techs.select(X.tech_text(F.col("t")).alias("x")).collect()] == ["R [js] | N [null]", "null"]


def test_csv_export_appends(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x"\ny'), ("b", None)], "n string, v string")
    file = str(tmp_path / "o.csv")
    assert readers.export_csv(rows, file, ["n", "v"]) == 2 and readers.export_csv(rows, file, ["n", "v"], append=True) == 2
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfn,v\r\n")
    assert [tuple(r) for r in readers.read_csv(spark, file, ["n", "v"]).collect()] == [("a", 'x"\ny'), ("b", None)] * 2
    assert readers.with_prompt_second(spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, prompt int")).columns == ["a", "b", "prompt", "c"]
    lines = R.prompt_lines(spark.createDataFrame([("promptB.txt", "one\n\n two \n")], "name string, value string"), blank=False)
    assert [(r.n, r.prompt) for r in lines.collect()] == [(1, "one"), (2, "two")]
    cache = spark.createDataFrame([("u", "h", ""), ("w", "", "timeout")], "url string, fetched_html string, fetch_error string")
    found = {r.url: r.cached_ok for r in readers.lookup_cache(spark.createDataFrame([("u",), ("v",), ("w",)], "url string"), cache).collect()}
    assert found == {"u": True, "v": False, "w": False}


def test_read_html_and_feature_table(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.html").write_bytes(b"<p>\xff\xc3\xa4</p>")
    (tmp_path / "s" / "b.htm").write_bytes(b"<p>b</p>")
    (tmp_path / "c.txt").write_bytes(b"no")
    assert sorted(r.html for r in readers.read_html(spark, str(tmp_path)).collect()) == ["<p>b</p>", "<p>ä</p>"]
    (tmp_path / "f.csv").write_text("flag,n,t,more\nYes,1.5,x,1\nnan,-,null,2\n")
    got = [tuple(r) for r in readers.read_features(spark, str(tmp_path / "f.csv"), ["flag", "n", "t"], ["flag"], ["n"]).collect()]
    assert got == [(True, 1.5, "x"), (False, None, None)]


def test_report(spark, tmp_path):
    from quellwerk.plans import feature_queries

    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    target = str(tmp_path / "features")
    features.features(feature_queries.records(table)).write.parquet(target)
    text = report.influence_report(spark.read.parquet(target))
    assert text.count("\n## ") == 25 and "| p0 |" in text
    (tmp_path / "i.png").write_bytes(b"png")
    page, missing = report.self_contained_html(text + "\n\n![a](i.png) ![b](../out.png) ![c](http://x/y.png)\n\n- one\n- **two**", tmp_path)
    assert missing == ["../out.png"] and "data:image/png;base64,cG5n" in page and '<div class="table-wrap"><table>' in page and "<li><strong>two</strong></li>" in page
