"""Sources, sinks, the queue's stream and model calls, on small files."""

import hashlib
import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizloom.operators import model_calls
from quizloom.plans import catalogue, document_queries
from quizloom.sources import files, sinks
from quizloom.streaming import buffer


def test_input_files_by_suffix(spark, tmp_path):
    for name in ("b.PDF", "a.csv", "skip.bin", "sub/c.xml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x\xffy")
    rows = files.input_files(spark, str(tmp_path)).select("path", "suffix", "tool").collect()
    assert [r["suffix"] for r in rows] == [".csv", ".pdf", ".xml"]
    assert [r["text"] for r in files.whole_texts(spark, str(tmp_path / "a.csv")).collect()] == ["xy"]


def test_metadata_in_its_three_forms(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"source_path": "s1", "mmd_path": "m1"}))
    (tmp_path / "two.json").write_text(json.dumps([{"source_path": "s2", "md_path": "m2"}, {"source_path": "s3", "markdown_path": "m3"}]))
    (tmp_path / "zed.json").write_text(json.dumps({"processed_files": [{"source_path": "s4", "Type": "Exam"}]}))
    (tmp_path / "run_summary.json").write_text(json.dumps({"source_path": "no"}))
    rows = files.metadata_records(spark, str(tmp_path)).select("source_path", "markdown_path").collect()
    assert [tuple(r) for r in rows] == [("s1", "m1"), ("s2", "m2"), ("s3", "m3"), ("s4", None)]


def test_benchmark_items_with_a_missing_category(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"MCQ": [{"question": "q1"}, {"question": "q2"}], "CBQ": []}))
    rows = files.benchmark_items(spark, str(tmp_path / "b.json")).orderBy("category", "item_index").collect()
    assert [(r["category"], r["item_index"], json.loads(r["item"])["question"]) for r in rows] == [("MCQ", 0, "q1"), ("MCQ", 1, "q2")]


def test_resuming(spark, tmp_path):
    fresh, out = spark.range(3), str(tmp_path / "out")
    assert files.resumed(spark, out, fresh).count() == 3
    spark.range(5).write.parquet(out)
    assert files.resumed(spark, out, fresh).count() == 5 and files.resumed(spark, out, fresh, force=True).count() == 3


def test_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1.005, None), ("n", None, 3)], "model string, score double, n int").coalesce(1)
    assert sinks.markdown_lines(rows, ["model", "score"]) == ["| model | score |", "| --- | --- |", "| m | 1.00 |", "| n |  |"]
    assert sinks.markdown_lines(rows.limit(0), ["model"]) == ["_No records._"]
    sinks.write_csv(rows, str(tmp_path / "csv"), ["n", "model"])
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines() == ["n,model", ",m", "3,n"]
    assert "## Scores" in sinks.report_document("T", {"Scores": (rows, ["model"])})


def test_queue_drains_once_and_routes_failures(spark, tmp_path):
    landing, out = tmp_path / "landing", [str(tmp_path / x) for x in ("ok", "failed", "checkpoint")]
    landing.mkdir()
    line = lambda i: json.dumps({"item_id": str(i), "source_path": f"s{i}"})
    (landing / "1.json").write_text("\n".join([line(1), line(2), "{broken"]))

    def process(rows):
        return rows.withColumn("status", F.when(F.col("item_id") == "2", "failed").otherwise("ok")).withColumn("error", F.lit("e"))

    buffer.drain(buffer.queue(spark, str(landing)), process, *out).awaitTermination()
    (landing / "2.json").write_text("\n".join([line(1), line(3)]))
    buffer.drain(buffer.queue(spark, str(landing)), process, *out).awaitTermination()
    got = buffer.latest(spark, out[0])
    assert sorted((r["item_id"], r["batch"]) for r in got.collect()) == [("1", 1), ("3", 1)]
    assert sorted(r["error"] for r in spark.read.parquet(out[1]).collect()) == ["e", "not JSON"]


@pytest.mark.parametrize("module, name", [(catalogue, "buffer_stream"), (document_queries, "buffer_follow")])
def test_pages_of_one_url_are_items_of_their_own(spark, tmp_path, module, name):
    rows = [(1, "u"), (2, "u"), (3, "u"), (4, "v"), (13, "v"), (14, "v")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    found = duckdb.sql(module.ORACLES[name].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = module.QUERIES[name](spark, str(tmp_path)).select("item_id", "source_path", "status").collect()
    assert sorted(map(tuple, got)) == sorted(found) and len(found) == 4


def test_keys_of_several_columns(spark, tmp_path):
    """Over two batches the newest result of each key stands; a part of a key may be null, and lines that don't parse are kept."""
    landing, out, key = tmp_path / "landing", [str(tmp_path / x) for x in ("ok", "failed", "checkpoint")], ["item_id", "markdown_path"]
    landing.mkdir()
    line = lambda **x: json.dumps({"item_id": "a", **x})
    done = lambda rows: rows.withColumn("status", F.lit("ok")).withColumn("error", F.lit(None).cast("string"))
    for n, lines in enumerate([[line(), line(), line(markdown_path="1"), "{broken"], [line(), line(markdown_path="2")]]):
        (landing / f"{n}.json").write_text("\n".join(lines))
        buffer.drain(buffer.queue(spark, str(landing)), done, *out, key).awaitTermination()
    got = buffer.latest(spark, out[0], key).collect()
    assert sorted((r["markdown_path"] or "", r["batch"]) for r in got) == [("", 1), ("1", 0), ("2", 1)]
    assert [r["payload"] for r in spark.read.parquet(out[1]).collect()] == ["{broken"]


def test_model_calls_keep_failed_rows_and_are_sent_once(spark):
    prompts = spark.createDataFrame([(1, "m", "hello"), (2, "m", "other"), (3, "m", None)], "request_id long, model string, prompt string")
    answers = {hashlib.sha256(b"hello").hexdigest(): "hi"}
    got = {r["request_id"]: r for r in model_calls.call_models(prompts, model_calls.replay(answers, "?")).collect()}
    assert [got[i]["response"] for i in (1, 2, 3)] == ["hi", "?", "?"]

    def broken():
        def call(prompt, model):
            raise OSError("down")

        return call

    lost = model_calls.call_models(prompts, broken)
    assert {(r["status"], r["error"]) for r in lost.collect()} == {("failed", "down")}
    done = spark.createDataFrame([("m", hashlib.sha256(b"hello").hexdigest(), "known", "ok")], "model string, prompt_sha256 string, response string, status string")
    again = {r["request_id"]: r["response"] for r in model_calls.call_once(prompts.where("prompt is not null"), done, model_calls.replay({}, "fresh")).collect()}
    assert again == {1: "known", 2: "fresh"}


def test_html_and_xml_become_the_markdown_that_is_expected(spark):
    pages = [
        (1, "<html><head><title> A &amp; B </title><style>x{}</style></head><body><h1>H</h1><p>one <b>two</b></p><script>no()</script></body></html>"),
        (2, "<p>only</p>"), (3, None), (4, "<title></title>x<template>t</template>y"),
    ]
    got = {r["k"]: r["text"] for r in files.html_markdown(spark.createDataFrame(pages, "k int, html string"), "k", "html", F.lit("stem")).collect()}
    assert got == {1: "# A & B\n\nA & B\nH\none\ntwo", 2: "# stem\n\nonly", 3: "# stem\n\n", 4: "# stem\n\nx\ny"}
    xml = [(1, "<a>p<b>q <c>r</c></b><d/></a>"), (2, "<n:a xmlns:n='u'>x</n:a>"), (3, "<a>"), (4, None)]
    got = {r["k"]: r["text"] for r in files.xml_markdown(spark.createDataFrame(xml, "k int, xml string"), "k", "xml").collect()}
    assert got == {1: "## a\n\npq r\n\n## b\n\nq r\n\n## c\n\nr", 2: "## a\n\nx", 3: None, 4: None}


def test_results_of_quick_calls_are_handed_on_together(monkeypatch):
    rows = pd.DataFrame({"k": range(500)})
    sizes = lambda: [len(x) for x in model_calls._in_slices(iter([rows, rows[:0], rows[:3]]), lambda r: (r.k,), ["k"], 2)]
    assert sizes() == [500, 3]
    monkeypatch.setattr(model_calls, "HELD_SECONDS", -1)
    assert sizes() == [48] * 10 + [20, 3]
