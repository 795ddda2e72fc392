"""Conversion by branches, metadata, and the rules of settings and names."""

import json

from pyspark.sql import functions as F

from quizloom.operators import build, convert, passes, scoring, tasks
from quizloom.sources import records


def _converted(spark, files, **more):
    rows = spark.createDataFrame([(p, None if c is None else bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in files], "path string, content binary")
    return {r["path"]: r for r in convert.convert(rows, **more).collect()}


def test_files_take_their_branch_or_its_fallback(spark):
    whole = "<html><head><title>T</title></head><body><h1>A &amp; B</h1><p>one<br>two <b>x</b></p><ul><li>i</li></ul><script>no()</script></body></html>"
    got = _converted(spark, [
        ("a.html", whole), ("b.HTM", "<title>T &amp; u</title><p>one\n<p>two"), ("c.html", "<p>x"), ("d.txt", b"x \xff \n\n\n\ny\n"), ("e.csv", 'a,b\n"1\n2",x|y\n3\n'), ("f.tsv", "a\tb\n"),
        ("g.csv", ""), ("h.csv", "a\n1,2\n"), ("i.xml", "<n:a xmlns:n='u'>p<b>q\n<c> r</c></b><d/></n:a>"), ("j.xml", "<!DOCTYPE x [<!ENTITY a 'aa'>]><x>&a;</x>"), ("k.xml", "<a>"),
        ("l.docx", "x"), ("m.pdf", "x"), ("n", "x"), ("o.html", None), ("dir.x/p.md", "# h"),
    ])
    told = {p: (r["tool"], r["status"], r["text"]) for p, r in got.items()}
    plain, pandoc, rows, xml = "convert_html_with_fallback", "convert_with_pandoc", "convert_tabular_document", "convert_xml_document"
    assert told["a.html"] == (pandoc, "completed", "# A & B\n\none two x\n\n- i")
    assert told["b.HTM"] == (plain, "completed", "# T & u\n\nT & u\none\ntwo") and told["c.html"] == (plain, "completed", "# c\n\nx")
    assert got["b.HTM"]["tried"] == [pandoc, plain] and got["a.html"]["tried"] == [pandoc] and got["b.HTM"]["suffix"] == ".htm"
    assert told["d.txt"] == (pandoc, "completed", "x\n\ny") and told["dir.x/p.md"] == (pandoc, "completed", "# h")
    assert told["e.csv"] == (rows, "completed", "## e\n\n| a | b |\n| --- | --- |\n| 1\n2 | x\\|y |\n| 3 |  |") and told["f.tsv"] == (rows, "completed", "## f\n\n(No rows found)")
    assert told["i.xml"] == (xml, "completed", "# i\n\n## a\n\np q r\n\n## b\n\nq r\n\n## c\n\nr")
    failed = {p: r["error"] for p, r in got.items() if r["status"] == "failed"}
    assert set(failed) == {"g.csv", "h.csv", "j.xml", "k.xml", "l.docx", "m.pdf", "n", "o.html"}
    assert failed["j.xml"] == "a document type isn't read" and failed["l.docx"] == "no converter for .docx" and failed["n"] == "Unsupported file suffix: ``"
    assert failed["m.pdf"] == "No converter for tool: deepseek_ocr2_to_markdown" and failed["o.html"] == "no content" and told["o.html"][0] == plain
    assert convert.convert(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_nothing_is_converted_twice(spark, tmp_path):
    def counted(name, fails):
        def one(path, content):
            with open(tmp_path / f"{name}-{path.name}", "a") as f:
                f.write("x")
            if fails(path):
                raise RuntimeError("broken")
            return name

        return convert.by_file(one)

    tools = {"convert_with_pandoc": counted("one", lambda p: p.stem == "b"), "convert_html_with_fallback": counted("two", lambda p: False)}
    rows = spark.createDataFrame([(f"{n}.html", bytearray(b"x")) for n in "abc"], "path string, content binary").repartition(3)
    done = convert.convert(rows, tools)
    assert {r["path"]: r["text"] for r in done.collect()} == {"a.html": "one", "b.html": "two", "c.html": "one"}
    done.count()
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"one-a.html": "x", "one-b.html": "x", "one-c.html": "x", "two-b.html": "x"}


def test_descriptions(spark):
    told = {
        "a": '{"Name": "n", "Date": null, "Authors": 5, "Brief Description": "", "Type": " Exam "}', "b": "no", "c": "[1]", "d": '{"error": "x", "Name": "n"}', "e": '```json\n{"Name": "m", "error": ""}\n```',
        "f": "x" * 2000,
    }

    def make():
        def call(prompt, model):
            if prompt == "g":
                raise OSError("down")
            return told[prompt]

        return call

    docs = spark.createDataFrame([(f"/in/{k}.x.html", f"A Case Report {k}") for k in "abcdefg"], "path string, text string")
    rendered = docs.withColumn("text", F.regexp_extract("text", "(.)$", 1))
    got = {r["path"][4]: r for r in passes.describe(rendered, "{text}", "m", make).collect()}
    assert tuple(got["a"])[1:] == ("n", "", "5", "", "MCQ", None) and got["e"]["Name"] == "m" and got["e"]["Metadata Warning"] is None
    assert got["b"]["Name"] == "b.x" and got["b"]["Metadata Warning"] == "Metadata extraction returned invalid JSON: no" and got["b"]["Brief Description"].startswith("Automatic")
    assert got["c"]["Metadata Warning"] == "Metadata extraction did not return JSON: [1]" and got["d"]["Metadata Warning"].startswith("Metadata extraction returned invalid JSON: {")
    assert len(got["f"]["Metadata Warning"]) == 1000 and "Request failed: down" in got["g"]["Metadata Warning"]
    cases = passes.describe(docs, "b", "m", make).collect()
    assert {r["Type"] for r in cases} == {"CaseReport"}


def test_settings_and_names(spark):
    assert records.setting(None, 0, 5) == 0 and records.setting("", "x") == "" and records.setting(None, None) is None
    assert [records.count_mode(m, t, s) for m, t, s in (("api", "x", {}), (None, "x", {}), ("auto", None, {"tokenizer": "y"}), ("auto", None, {}))] == ["api", "local", "local", "api"]
    t = spark.createDataFrame([(" a ",), ("b.json",), (" ",), (None,)], "n string")
    assert [r[0] for r in t.select(records.benchmark_filename(F.col("n"))).collect()] == ["a.json", "b.json", "benchmark.json", "benchmark.json"]


def test_response_letters(spark):
    told = ['{"answer": " b) "}', '{"answer": "b", "status": "failed"}', '{"status": "ok"}', "c.", None, '{"answer": null}', "[1]", '{"answer": ["D"]}']
    t = spark.createDataFrame(list(enumerate(told)), "i int, r string")
    got = [r["x"] for r in t.select("i", scoring.response_letter(F.col("r")).alias("x")).orderBy("i").collect()]
    assert got[:6] == ["B", "", "", "C", "", ""]


def test_records_of_json(spark):
    items = [None, "[]", "5", '{"question": "q", "options": {"A": 1}, "answer": "A", "Type": "MCQ"}', json.dumps({"question": "q", "key_points": [{"content": "c"}, 5]})]
    t = spark.createDataFrame([(i, "CaseReport", x) for i, x in enumerate(items)], "i int, category string, item string")
    got = {r["i"]: r for r in build.json_records(t, "i").withColumn("reason", build.reason(build.json_records(t, "i"))).collect()}
    assert [got[i]["reason"] for i in range(3)] == ["not_json_object"] * 3 and got[3]["reason"] == "passed" and got[3]["n_options"] == 1
    assert got[4]["points"] == ["c", None] and got[4]["reason"] == "incomplete_case_report"


def test_cached_results_are_not_made_again(spark):
    rows = spark.range(5).withColumnRenamed("id", "k")
    cached = spark.createDataFrame([(1, "old"), (3, "old"), (9, "other")], "k long, v string")
    seen = []
    got = tasks.with_cached(rows, cached, "k", lambda r: seen.extend(x["k"] for x in r.collect()) or r.withColumn("v", F.lit("new")))
    assert {r["k"]: r["v"] for r in got.collect()} == {0: "new", 1: "old", 2: "new", 3: "old", 4: "new"} and sorted(seen) == [0, 2, 4]
