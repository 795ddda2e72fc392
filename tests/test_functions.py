"""Golden vectors of the text functions and of the scores."""

import pytest
from pyspark.sql import functions as F

from quizloom.functions import ocr
from quizloom.functions import text as T
from quizloom.operators import build, questions, scoring


def _map(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["v"] for r in rows.select("i", function(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (T.clean_text, {"a  \n\n\n\nb\t\n c \n": "a\n\nb\n c", "": "", " ": "", "a\r\nb": "a\nb", None: None}),
        (T.normalize_text, {"a\r\n\n\n\nb \r": "a\n\nb", "": ""}),
        (T.normalize_question, {"  A  b\n\tC ": "a b c", "": ""}),
        (T.normalize_heading, {"Class III: 牙-周": "classiii牙周", "--": ""}),
        (T.option_letter, {"I think A": "I", "Option (c)": "C", "Request failed: 401": "R", "1": "1", "x_A": "X", "A-1": "A", "": "", None: ""}),
        (
            T.risk_level,
            {"0": "S0", "1": "S0", "2": "S1", "3": "S2", "s2": "S2", "Level S1.": "S1", "risk 3": "S2", "S3": "", "S2/S1": "S2", "4": "", "True": "", None: ""},
        ),
        (T.canonical_type, {" Exam ": "MCQ", "case_report": "CaseReport", "SAQ": "SAQ", " Other ": "Other", None: ""}),
        (T.discipline_number, {"Peri-implant gingival loss": 10, "pulp extraction": 2, "class III": 12, "nothing": 0}),
        (T.suffix, {"/a/b.PDF": ".pdf", "/a/.hidden": "", "/a.b/c": ""}),
        (T.file_stem, {"/a/b.tar.gz": "b.tar", "c": "c"}),
        (lambda c: T.truncate_chars(c, 5), {"abcdef": "ab...", "abcde": "abcde", "": ""}),
        (lambda c: T.truncate_words(c, 2), {"a b  c": "a b", "a  b": "a  b"}),
        (T.strip_json_fence, {"```json\n{}\n```": "{}", "{}": "{}"}),
    ],
)
def test_text(spark, function, cases):
    assert _map(spark, function, list(cases)) == list(cases.values())


def test_half_even_rounding(spark):
    values = [2.675, 3.125, 0.025, 0.005, 1.005, 33.335, -2.5, 1234567.891]
    assert _map(spark, T.round_half_even, values, "double") == [round(v, 2) for v in values]


def test_scores(spark):
    assert _map(spark, scoring.positive, ["true", "1", " YES ", "1.0", "hit", "2", None]) == [True, True, True, False, False, False, False]
    hits = [["true", "hit", "1", "no"], ["true"] * 6, [], None]
    assert _map(spark, lambda c: scoring.key_point_score(c, F.lit("0.5")), hits, "array<string>") == [60.0, 100.0, 0.0, 50.0]
    letters = [("b", "B."), ("B.", "b"), ("", "A"), ("b", None)]
    rows = spark.createDataFrame(letters, "r string, a string").select(scoring.choice_score(F.col("r"), F.col("a")).alias("s"))
    assert [r["s"] for r in rows.collect()] == [100.0, 100.0, 0.0, 0.0]


def test_macro_skips_missing_categories(spark):
    rows = spark.createDataFrame([("m", "SAQ", 80.0), ("m", "CBQ", 40.0)], "model string, category string, score double")
    r = scoring.report(rows, ["model"]).first()
    assert (r["MCQ_score"], r["MCQ_n"], r["macro_average_score"], r["micro_average_score"]) == (None, 0, 60.0, 60.0)
    assert scoring.report(rows.where("false"), ["model"]).count() == 0


def test_ocr_regions(spark):
    page = "a<|ref|>image<|/ref|><|det|>[[0,0,999,999]]<|/det|>b\n\n\n\nc"
    assert _map(spark, lambda c: ocr.strip_references(c, F.lit(3)), [page, "", "plain"]) == ["a![](images/3_0.jpg)\nb\n\nc", "", "plain"]


def test_best_candidate_ties_by_order(spark):
    rows = spark.createDataFrame([(1, 1, 3, 2), (1, 1, 3, 1), (1, 0, 9, 0)], "doc int, passed int, total int, chunk int")
    assert [r["chunk"] for r in questions.best_candidate(rows, "doc", "passed", "total", "chunk").collect()] == [1]


def test_failed_records(spark):
    rows = spark.createDataFrame([(" Failed ", None), ("ok", "x"), ("ok", ""), (None, None)], "s string, e string")
    assert [r[0] for r in rows.select(build.failed(F.col("s"), F.col("e"))).collect()] == [True, True, False, False]
