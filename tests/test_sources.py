"""Readers and writers on files that the provided tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from quellwerk.functions import text as X
from quellwerk.operators import search as L
from quellwerk.sources import fetching, readers


def test_read_html(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_bytes("<p>ä</p>".encode() + b"\xff")
    (tmp_path / "a" / "y.htm").write_text("")
    (tmp_path / "a" / "z.txt").write_text("no page")
    got = {r.path.rsplit("/", 1)[1]: r.html for r in readers.read_html(spark, str(tmp_path)).collect()}
    assert got == {"x.html": "<p>ä</p>"}


def test_read_prompts(spark, tmp_path):
    (tmp_path / "promptB.txt").write_text("one\n\ntwo")
    assert [(r.name, r.value) for r in readers.read_prompts(spark, str(tmp_path)).collect()] == [("promptB.txt", "one\n\ntwo")]


def test_failures_and_done_ids(spark, tmp_path):
    failure = {"url": "u", "error_class": "timeout", "attempts": 3, "source_files": ["a", "b"], "unknown": 1}
    (tmp_path / "f.jsonl").write_text(json.dumps(failure) + "\n")
    row = readers.read_failures(spark, str(tmp_path / "f.jsonl")).first()
    assert (row.url, row.attempts, row.source_files, row.status_code) == ("u", 3, ["a", "b"], None)
    (tmp_path / "d.jsonl").write_text('{"record_id":"a"}\n{"record_id":"a","x":1}\n{"x":2}\nbroken\n')
    assert [r.record_id for r in readers.done_ids(spark, str(tmp_path / "d.jsonl")).collect()] == ["a"]


def test_records_of_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source_file": "a", "citations": [{"url": "u"}], "more": {"x": 1}}, indent=2))
    (tmp_path / "b.json").write_text('{"source_file": "b", "citations": [')
    assert [(r.source_file, r.citations[0].url) for r in readers.read_records(spark, str(tmp_path)).collect()] == [("a", "u")]


def test_index_and_bodies(spark, tmp_path):
    cited = "array<struct<url string, fetched_html string, fetched_html_path string>>"
    rows = spark.createDataFrame([("a", [("u", "<p>", ""), ("v", None, "kept")]), ("b", [("u", "<p>", "")]), ("c", [])], f"source_file string, citations {cited}")
    readers.write_index(rows, str(tmp_path / "out"))
    bodies = spark.read.parquet(str(tmp_path / "out" / "bodies")).collect()
    index = {r.source_file: r.citations for r in readers.read_records(spark, str(tmp_path / "out" / "index"), lines=True).collect()}
    assert [r.html for r in bodies] == ["<p>"] and index["c"] == []
    assert [(x.fetched_html, x.fetched_html_path) for x in index["a"]] == [("", bodies[0].path), ("", "kept")]


def test_csv_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, " a\n,\"b\"\t"), (2, None)], "n int, t string")
    file = tmp_path / "one.csv"
    assert readers.export_csv(rows, str(file), ["n", "t"]) == 2 and readers.export_csv(rows, str(file), ["n", "t"], append=True) == 2
    assert file.read_bytes().startswith("﻿n,t".encode()) and file.read_text().count("n,t") == 1
    for path in (str(file), str(tmp_path / "many")):
        if path.endswith("many"):
            readers.write_csv(rows, path, ["n", "t"])
            readers.write_csv(rows, path, ["n", "t"], mode="append")
        got = sorted(tuple(r) for r in readers.read_csv(spark, path, ["n", "t"], na=False).collect())
        assert got == [("1", " a\n,\"b\"\t")] * 2 + [("2", "")] * 2
    with pytest.raises(Exception, match="missing"):
        readers.write_csv(rows, str(tmp_path / "none"), ["missing"])


def test_prompt_is_the_third_column(spark):
    rows = spark.createDataFrame([(1, 2, 3, "p")], "a int, b int, c int, prompt string")
    assert readers.with_prompt_second(rows).columns == ["a", "b", "prompt", "c"]


def test_blank_prompts_and_names(spark):
    from quellwerk.operators import records as R

    files = spark.createDataFrame([("promptC.txt", "a\r\n　\n \t\nb　\n")], "name string, value string")
    assert [(r.n, r.prompt) for r in R.prompt_lines(files, blank=False).collect()] == [(1, "a"), (2, "b")]
    assert [(r.n, r.prompt) for r in R.prompt_lines(files).collect()][0::3] == [(1, "a"), (4, "b　")]
    names = spark.createDataFrame([("Site+12",), ("A+B",), ("+3",)], "n string").select(X.strip_badge(F.col("n")).alias("x"))
    assert [r.x for r in names.collect()] == ["Site", "A+B", ""]


def test_helpers_go_if_they_are_there(spark):
    assert L.without_helpers(spark.range(1).withColumn("_h", F.lit(1)), "_h", "_absent").columns == ["id"]


def test_download(tmp_path):
    file = tmp_path / "d.zip"
    assert fetching.download([b"ab", b"", b"c"], str(file)) == 3 and file.read_bytes() == b"abc"


def test_error_classes_agree(spark):
    cases = [("Read timed out", None, ""), ("SSLError", None, ""), ("", 429, ""), ("", 500, ""), ("", 200, "Attention Required"), ("odd", None, ""), ("", 200, "")]
    rows = spark.createDataFrame(cases, "e string, s int, b string").select("*", X.error_class(F.col("e"), F.col("s"), F.col("b")).alias("k")).collect()
    assert [r.k for r in rows] == [fetching.classify(*case) for case in cases]
