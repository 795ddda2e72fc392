"""Run records: written and read again, and settings."""

import json

import pytest
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.sources import records, scratch, sinks


def test_resume_index_round_trip(spark, tmp_path):
    rows = [(f'/a "{i}"/é', json.dumps({"source_path": f"s{i}", "status": "done"})) for i in range(20)]
    records.write_resume_index(spark.createDataFrame(rows, "source_path string, record string"), str(tmp_path / "index"))
    lines = spark.read.text(str(tmp_path / "index")).select(F.lit(1).alias("k"), F.col("value").alias("payload"))
    got = {r["source_path"]: json.loads(r["record"]) for r in records.resume_index(lines, "k", "payload").collect()}
    assert got == {s: json.loads(r) for s, r in rows}


def test_broken_payloads_have_no_rows(spark):
    bad = spark.createDataFrame([(1, "nonsense"), (2, None), (3, "[1]"), (4, "{}"), (5, '{"records": 3}'), (6, '{"a": {"b": 1}, "c": 2}')], "k int, payload string")
    assert {(r["k"], r["source_path"]) for r in records.resume_index(bad, "k", "payload").collect()} == {(6, "a")}
    assert records.summary_items(bad, "k", "payload").count() == 0


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"default": {"model": "d", "x": null}, "big": {"model": "b"}}')
    (tmp_path / "a.yaml").write_text("a:\n  b: '{text}'\n")
    found = records.load_settings(str(tmp_path / "a.json"))
    assert records.model_settings(found, "big") == {"model": "b"} and records.model_settings(found, "no") == {"model": "d"}
    assert records.load_settings(str(tmp_path / "a.yaml")) == {"a": {"b": "{text}"}}
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        records.load_settings(str(tmp_path / "b.json"))


def test_texts_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# a\nb"), (2, "é")], "doc int, text string")
    sinks.write_texts(docs, str(tmp_path / "md"), "doc", "text")
    got = {r["doc"]: r["value"] for r in spark.read.text(str(tmp_path / "md"), wholetext=True).collect()}
    assert got == {1: "# a\nb\n", 2: "é\n"}
    assert sinks.replace_or_remove(docs, str(tmp_path / "csv"), ["doc"]) and (tmp_path / "csv").exists()
    assert not sinks.replace_or_remove(docs.limit(0), str(tmp_path / "csv"), ["doc"]) and not (tmp_path / "csv").exists()


def test_scratch_tables_can_be_removed(spark):
    before = scratch.stored()
    kept = scratch.store(spark.range(3), "x")
    new = [p for p in scratch.stored() if p not in before]
    assert kept.count() == 3 and len(new) == 1
    scratch.remove(spark, new)
    assert scratch.stored() == before


def test_merged_maps(spark):
    t = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"}), ({"a": "5"}, None)], "a map<string,string>, b map<string,string>")
    assert [r[0] for r in t.select(T.merge_maps(F.col("a"), F.col("b"))).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}, {"a": "5"}]
