"""Queries with SQL on the smallest tables, held-out accuracy, and the pipeline's stages."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quellwerk.llm import common, decontaminate, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_held_out_quality_and_language(spark):
    d = DIR.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES["op3_quality"](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.QUERIES["op7_language"](spark, d).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
        own = {r.doc_id for r in docs.select("doc_id").collect()}
        assert own <= ids and len(own) > len(ids) / 2, name
        ids = own
        if name == "decontamination":
            assert decontaminate.annotate(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).filter("contaminated").isEmpty()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {"shard_id", "shard_bytes"} <= set(out.columns) and out.count() == docs.count()


def odd_rows(spark):
    base = " ".join(f"some{i}" for i in range(30))
    rows = [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, base + " more", None, None, None), (None, "a text without an id of its own here", "en", None, 1), (4, None, "en", "a", 0), (5, "", "en", "b", 0), (6, "the same", "fr", "b", 8), (6, "the same", "fr", "b", 8), (6, "another text", "fr", "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "id", "score", "hit_items", "n_words", "_row", "_text", "_tie", "size", "cell", "bytes"):
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


def test_stages_on_odd_rows_and_empty_tables(spark):
    docs = odd_rows(spark)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DIR)
        extra = [c for c in got.columns if c not in docs.columns]
        assert got.columns[: len(docs.columns)] == docs.columns or set(docs.columns) <= set(got.columns), name
        assert extra == ([] if name != "sharding" else ["n_bytes", "shard_id", "shard_bytes", "shard_docs"])
        rows = got.collect()
        assert all(r.row == r.id == r.score == r._text == r.cell == "mine" for r in rows), name
        left[name] = sorted((str(r.doc_id) for r in rows))
        assert stage(spark, docs.limit(0), DIR).collect() == []
    assert left["language"] == ["1", "2", "3", "6", "6", "6", "None"]  # no letters in 4 and 5
    assert left["near duplicates"] == ["1", "4", "5", "6", "None"]
    assert left["decontamination"] == ["1", "2", "3", "4", "5", "6", "6", "6", "None"]
    assert {"1", "6"} <= set(left["mixing"]) and not {"4", "5"} & set(left["mixing"])
    assert left["sharding"] == left["decontamination"]


def test_run_leaves_its_last_table_alone(spark, tmp_path):
    for name, rows in (("documents", odd_rows(spark)), ("benchmark", spark.createDataFrame([(1, "nothing of it")], "item_id long, text string"))):
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = common.shared_dir(spark).removeprefix("file://") + "/quellwerk"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"shard_id"} <= set(out.columns) and {r.doc_id for r in out.collect()} == {1, 6, None}
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before] == ["sharding"]
