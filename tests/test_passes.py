"""Model passes against plain Python with the same stand-in for a model, and reply columns case by case."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quizloom.functions import replies
from quizloom.operators import passes, questions
from quizloom.operators.completions import Completions
from quizloom.plans import model_queries as mq


@pytest.mark.parametrize("name", sorted(mq.ORACLES))
def test_same_as_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    found = con.execute(mq.ORACLES[name])
    columns = [d[0] for d in found.description]
    got = mq.QUERIES[name](spark, tiny)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


def chunks(spark, tiny):
    return [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "text").collect()]


def good(item):
    return all(str(item.get(k) or "").strip() for k in ("from", "question", "answer")) and item["answer"] in item["options"]


def test_generation_repairs_and_keeps_first_questions(spark, tiny):
    want = {}
    for conv, turn, text in sorted(chunks(spark, tiny)):
        reply = mq.client(f"ITEMS {text}", "m")
        for nth, item in enumerate(json.loads(reply) if reply.startswith("[") else []):
            repaired = not good(item)
            if repaired:
                item = json.loads(mq.client("REPAIR " + json.dumps(item, separators=(",", ":"), sort_keys=True) + f" {text}", "m"))
            if item and good(item):
                want.setdefault((conv, item["question"].strip().lower()), (turn, nth, repaired, item["question"], item["answer"]))
    got = {(r["conv_id"], r["question"].strip().lower()): tuple(r)[1:] for r in mq.generate_items(spark, tiny).collect()}
    assert got == want and any(v[2] for v in want.values())


def test_tagging_takes_the_first_valid_try(spark, tiny):
    rows = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()}
    got = {r["item_id"]: r for r in mq.tag_items(spark, tiny).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        d = mq.digits(f"TAGS {text}")
        if d[0] % 2 == 0:
            assert (got[i]["number"], got[i]["level"]) == (d[1] % 14 + 1, f"L{d[2] % 3 + 1}")
        else:
            assert got[i]["level"] in ("L1", "L2", "L3") and got[i]["number"] >= 0


def test_tagging_goes_on_until_a_try_is_valid(spark, tmp_path):
    """Replies that change from try to try: the third of one item is valid, none of the other's is."""
    said = {"a": ["nothing", "15 L9", "8 L2", "9 L1"], "b": ["?", "??", "???", "9 L1"]}

    def changing():
        def call(prompt, model):
            path = tmp_path / prompt.split()[1]
            n = len(path.read_text()) if path.exists() else 0
            path.write_text("x" * (n + 1))
            return said[prompt.split()[1]][n]

        return call

    items = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    got = {r["id"]: r["tags"] for r in passes.tag(items, "TAGS {text}", "m", changing).collect()}
    assert (got[1]["number"], got[1]["level"]) == (8, "L2") and got[2]["number"] == 0
    assert [len((tmp_path / x).read_text()) for x in "ab"] == [3, 3]
    log = Completions(changing, str(tmp_path / "log"))
    for x in "ab":
        (tmp_path / x).unlink()
    for _ in range(2):  # the tries of one prompt are told apart in the log, and none is sent again
        got = {r["id"]: r["tags"] for r in passes.tag(items, "TAGS {text}", "m", log).collect()}
        assert (got[1]["number"], got[1]["level"]) == (8, "L2")
        assert [len((tmp_path / x).read_text()) for x in "ab"] == [3, 3]


def _case(k, **more):
    points = [{"content": f"c{i}", "location": "l", "explanation": "e"} for i in range(5)]
    return {"seed_question": {"question": f"q{k}", "location": "l", "explanation": "e"}, "key_points": points} | more


def test_many_candidates_are_compared_in_lists(spark):
    """The model picks the last of each list, so lists of three end at the last chunk; a reply that picks none leaves the first."""
    passed = {c: {"score": 1} for c in replies.CRITERIA}
    rows = [("k", i, json.dumps(_case(i)), json.dumps(passed)) for i in range(20)] + [("one", 0, json.dumps(_case(0)), json.dumps(passed))]
    t = spark.createDataFrame(rows, "k string, chunk_index int, case string, v string").select("k", "chunk_index", "case", replies.validation(F.col("v")).alias("validation"))

    def last():
        return lambda prompt, model: json.dumps({"selected_index": len(json.loads(prompt)) - 1})

    for make, want in ((last, {"k": 19, "one": 0}), (lambda: lambda prompt, model: "none", {"k": 0, "one": 0})):
        got = passes.select_cases(t, "k", "{candidates}", "m", make, most=3).collect()
        assert {r["k"]: r["chunk_index"] for r in got} == want and len(got) == 2


def test_selected_index(spark):
    told = ['{"selected_index": 1}', '{"selected_index": 2}', '{"selected_index": -1}', '{"selected_index": "1"}', '{"selected_index": true}', '{"selected_index": 1.0}', "x", None]
    t = spark.createDataFrame(list(enumerate(told)), "i int, r string")
    assert [r["j"] for r in t.select("i", replies.chosen_index(F.col("r"), F.lit(2)).alias("j")).orderBy("i").collect()][:5] == [1, None, None, None, 1]


@pytest.mark.parametrize("case, want", [
    (_case(1), "ok"), (_case(1, seed_question="q"), "seed_question"), (_case(1, seed_question={"question": "q", "location": 5}), "seed_question.location"),
    (_case(1, key_points=[]), "five_key_points"), (_case(1, key_points={"a": 1}), "five_key_points"), (_case(1, key_points=[{}] * 5), "key_point_1"),
    (_case(1, key_points=_case(1)["key_points"][:4] + ["x"]), "key_point_5"), ([1], "not_an_object"), ("x", "not_an_object"),
])
def test_case_structure(spark, case, want):
    t = spark.createDataFrame([(json.dumps(case),)], "c string")
    assert t.select(questions.item_problem(F.col("c"), "CaseReport")).first()[0] == want


def test_broken_cases_are_never_judged(spark, tmp_path):
    def counted():
        def call(prompt, model):
            kind, _, rest = prompt.partition(" ")
            if kind == "VALIDATE":
                json.loads(rest)
                assert questions_ok(rest)
                return json.dumps({c: {"score": 0} for c in replies.CRITERIA})
            return json.dumps(_case(1)) if kind == "CASE" and rest == "good" else "[]"

        def questions_ok(text):
            return len(json.loads(text)["key_points"]) == 5

        return call

    docs = spark.createDataFrame([("a", 0, "good"), ("a", 1, "bad"), ("b", 0, "bad")], "k string, chunk_index int, text string")
    chosen, failed = passes.cases(docs, "k", mq.CASES, "m", counted)
    assert chosen.collect() == [] and sorted(r["k"] for r in failed.collect()) == ["a", "b"]


def test_failed_calls_keep_their_rows(spark):
    def broken():
        def call(prompt, model):
            if "x" in prompt or model == "judge":
                raise RuntimeError("down")
            return "A"

        return call

    items = spark.createDataFrame([("MCQ", 1, "x"), ("MCQ", 2, "y"), ("SAQ", 3, "y"), ("CBQ", 4, "x")], "category string, item_index int, question string")
    items = items.selectExpr("*", "'o' as options", "'a' as answer", "'p' as points")
    got = {r["item_index"]: r for r in passes.evaluate(items, ["m"], "judge", mq.PROMPTS, broken).collect()}
    assert {i: (r["status"], r["answer"], r["judge"]) for i, r in got.items()} == {1: ("failed", None, None), 2: ("ok", "A", None), 3: ("failed", None, None), 4: ("failed", None, None)}
    assert got[1]["error"] == "down"
    tagged = passes.tag(spark.createDataFrame([(1, "dental x"), (2, None)], "id int, text string"), "TAGS {text}", "m", broken).collect()
    assert len(tagged) == 2


def test_reply_columns(spark):
    cases = ['{"score": 1}', '{"score": true, "key_points": [{"hit": true}, {"hit": "no"}, 3]}', "[1]", "x" * 400, None, "", '```json\n{"score": null, "reason": "r"}\n```']
    t = spark.createDataFrame(list(enumerate(cases)), "i int, r string")
    judged = [r["j"] for r in t.select("i", replies.judge(F.col("r")).alias("j")).orderBy("i").collect()]
    assert [j["score"] for j in judged] == ["1", "true", "0", "0", "0", "0", None]
    assert judged[3]["reason"] == "Judge did not return JSON: " + "x" * 300 and judged[6]["reason"] == "r" and judged[0]["hits"] is None
    risks = ['{"risk_level": "", "level": "s2"}', '{"raw_content": "level S0"}', '{"risk_level": 0, "level": 2}', "3", "", None, '{"risk_level": "x", "level": "S1"}']
    t = spark.createDataFrame(list(enumerate(risks)), "i int, r string")
    told = [r["j"] for r in t.select("i", replies.risk(F.col("r")).alias("j")).orderBy("i").collect()]
    assert [j["risk_level"] for j in told] == ["S2", "S0", "S1", "S2", "", "", ""] and told[4]["status"] == "failed"
    checks = ['{"correctness": {"score": 1}, "difficulty": {"score": 1.0, "reasoning": "d"}, "answerability": {"score": true}}', '{"correctness": {"score": "1"}, "difficulty": 3}', "no", None]
    t = spark.createDataFrame(list(enumerate(checks)), "i int, r string")
    told = [r["j"] for r in t.select("i", replies.validation(F.col("r")).alias("j")).orderBy("i").collect()]
    assert [(j["overall_passed"], j["total_score"]) for j in told] == [(1, 3), (0, 0), (0, 0), (0, 0)] and told[0]["difficulty"]["reasoning"] == "d"
