"""Files of documents, the benchmark file, and the queue that is followed."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quizloom.sources import document_files, files, sinks
from quizloom.streaming import buffer


def test_one_file_a_document(spark, tmp_path):
    document_files.register(spark)
    rows = [("a/b/1.mmd", "é\n"), ("2.mmd", None), ("a/3.txt", "x" * 100_000), ("sp ace/ü.mmd", "")]
    t = spark.createDataFrame(rows, "path string, text string").repartition(3)
    t.write.format("document_files").mode("append").save(str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {k: v or "" for k, v in rows}
    t.limit(0).write.format("document_files").mode("append").save(str(tmp_path / "out"))
    got = spark.read.format("document_files").option("suffixes", ".mmd").load(f"file://{tmp_path}/out")
    assert {r["path"]: r["text"] for r in got.collect()} == {k: v or "" for k, v in rows if k.endswith(".mmd")}
    spark.createDataFrame([("2.mmd", "new")], "path string, text string").write.format("document_files").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "2.mmd").read_text() == "new" and len(list((tmp_path / "out").rglob("*.mmd"))) == 3


@pytest.mark.parametrize("bad", ["../x.mmd", "/x.mmd", "a/../../x.mmd", None])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    document_files.register(spark)
    t = spark.createDataFrame([("ok.mmd", "x"), (bad, "y")], "path string, text string").coalesce(1)
    with pytest.raises(Exception, match="not a path below the folder"):
        t.write.format("document_files").mode("append").save(str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_partitions_of_many_files(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"{i}.md").write_text("x" * 10)
    monkeypatch.setattr(document_files, "PARTITION_BYTES", 50)
    parts = document_files._Reader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 8 and sum(len(p.paths) for p in parts) == 40
    assert document_files._Reader({"path": str(tmp_path), "suffixes": ".txt"}).partitions() == [document_files.Files([])]


def test_benchmark_file_keeps_what_it_does_not_know(spark, tmp_path):
    whole = {"MCQ": [{"question": "é", "n": {"b": [1, 2.5]}}, {"question": "q2"}], "note": {"x": [1]}, "CBQ": [{"seed": "s"}], "a-b": "t", "version": 3}
    (tmp_path / "in.json").write_text(json.dumps(whole))
    items, rest = files.benchmark_items(spark, str(tmp_path / "in.json")), files.benchmark_rest(spark, str(tmp_path / "in.json"))
    assert json.loads(rest) == {"note": {"x": [1]}, "a-b": "t", "version": 3}
    sinks.write_benchmark(items.repartition(3), str(tmp_path / "out"), rest)
    (written,) = (tmp_path / "out").glob("part-*")
    assert json.loads(written.read_text()) == whole | {"SAQ": []}
    again = files.benchmark_items(spark, str(written)).collect()
    assert sorted((r["category"], r["item_index"], json.loads(r["item"])["question"] if r["category"] == "MCQ" else "") for r in again) == [("CBQ", 0, ""), ("MCQ", 0, "é"), ("MCQ", 1, "q2")]
    sinks.write_benchmark(items.limit(0), str(tmp_path / "none"))
    (written,) = (tmp_path / "none").glob("part-*")
    assert json.loads(written.read_text()) == {"MCQ": [], "SAQ": [], "CBQ": []}


def test_run_summary(spark, tmp_path):
    rows = [("b", "completed", None, 3), ("a", "completed", None, 4), ("c", "failed", "broken", None)]
    sinks.write_run_summary(spark.createDataFrame(rows, "source_path string, status string, error string, n int"), str(tmp_path / "s"))
    (written,) = (tmp_path / "s").glob("part-*")
    assert json.loads(written.read_text()) == {"processed_files": [{"source_path": "a", "n": 4}, {"source_path": "b", "n": 3}], "failed_files": [{"source_path": "c", "error": "broken"}]}


def test_a_single_file_is_read_whatever_its_suffix(spark, tmp_path):
    for name in ("a.zip", "b.html", "c.md"):
        (tmp_path / name).write_text("x")
    names = lambda path: [r["path"].rpartition("/")[2] for r in files.input_files(spark, str(path)).select("path").collect()]
    assert names(tmp_path) == ["b.html", "c.md"] and names(tmp_path / "a.zip") == ["a.zip"]


def _line(i, source="s"):
    return json.dumps({"item_id": str(i), "source_path": source, "markdown_path": "m", "metadata_path": "d", "type": "MCQ"})


def test_followed_queue_works_on_each_key_once(spark, tmp_path):
    """A key that comes again in a later batch isn't worked on again; the stream ends when nothing comes, and by the producer's mark."""
    new, mark = tmp_path / "new", tmp_path / "mark"
    new.mkdir()
    seen = tmp_path / "seen"
    seen.write_text("")

    def process(rows):
        with open(seen, "a") as f:
            f.writelines(r["item_id"] + "\n" for r in rows.collect())
        return rows.withColumn("status", F.lit("completed")).withColumn("error", F.lit(None).cast("string"))

    def follow(**more):
        out = [str(tmp_path / x) for x in ("done", "failed", "checkpoint")]
        return buffer.follow(buffer.once(buffer.queue(spark, str(new))), process, *out, poll=0.2, **more)

    (new / "1.json").write_text("\n".join([_line(1), _line(2), "nonsense", _line(1, "again")]))
    began = time.monotonic()
    assert follow(idle=2.0) == "idle" and time.monotonic() - began >= 2.0
    assert sorted(seen.read_text().split()) == ["1", "2"]

    def produce():
        time.sleep(1)
        (new / ".2").write_text("\n".join([_line(2), _line(3), "nonsense"]))
        (new / ".2").rename(new / "2.json")
        time.sleep(1)
        mark.mkdir()

    producer = threading.Thread(target=produce)
    producer.start()
    assert follow(idle=60.0, done_mark=str(mark)) == "done"
    producer.join()
    assert sorted(seen.read_text().split()) == ["1", "2", "3"]
    assert sorted(r["item_id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == ["1", "2", "3"]
    assert [r["error"] for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == ["not JSON"]


def test_failures_end_the_followed_stream(spark, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "1.json").write_text(_line(1))

    def process(rows):
        raise RuntimeError("broken for good")

    with pytest.raises(Exception, match="broken for good"):
        buffer.follow(buffer.once(buffer.queue(spark, str(tmp_path / "new"))), process, *(str(tmp_path / x) for x in "abc"), poll=0.2, idle=30.0)
