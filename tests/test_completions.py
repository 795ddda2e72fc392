"""Endpoints in both dialects, and the log of calls: killed runs, failed calls and forced ones."""

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from quizloom.functions import payloads
from quizloom.operators import passes
from quizloom.operators.completions import Completions, usage
from quizloom.operators.model_calls import Endpoint, call_models
from quizloom.plans import model_queries as mq


def _payload(spark, **more):
    t = spark.createDataFrame([("m", "say \"é\"\n", "s", ["data:x"])], "m string, p string, s string, i array<string>")
    return json.loads(t.select(payloads.payload(F.col("m"), F.col("p"), **more)).first()[0])


def test_chat_payload(spark):
    user = {"role": "user", "content": [{"type": "text", "text": "say \"é\"\n"}]}
    assert _payload(spark) == {"model": "m", "messages": [user]}
    shown = {"role": "user", "content": [*user["content"], {"type": "image_url", "image_url": {"url": "data:x"}}]}
    whole = _payload(spark, system=F.col("s"), images=F.col("i"), json_output=True, stream=True, max_tokens=3, temperature=0.0, reasoning_effort="low", extra={"a": {"b": [1]}, "stream": False})
    assert whole == {
        "model": "m", "messages": [{"role": "system", "content": "s"}, shown], "max_tokens": 3, "max_completion_tokens": 3, "temperature": 0.0,
        "reasoning_effort": "low", "response_format": {"type": "json_object"}, "stream": False, "a": {"b": [1]},
    }
    assert _payload(spark, max_tokens=3, only_max_tokens=True, system=F.lit("")) == {"model": "m", "messages": [user], "max_tokens": 3}


def test_responses_payload(spark):
    got = _payload(spark, dialect=payloads.RESPONSES, system=F.col("s"), max_tokens=3, temperature=1.0, reasoning_effort="high", json_output=True, extra={"store": True})
    assert got == {"model": "m", "input": "say \"é\"\n", "max_output_tokens": 3, "temperature": 1.0, "instructions": "s", "reasoning": {"effort": "high"}, "store": True}


def test_urls():
    url = payloads.endpoint_url
    assert url({"url": "http://a/x/"}) == "http://a/x" and url({}) == "" and url({"base_url": "http://a/v1/"}) == "http://a/v1/chat/completions"
    assert url({"base_url": "http://a/chat/completions"}) == "http://a/chat/completions"
    assert url({"base_url": "http://a/v1", "api_type": "responses"}) == "http://a/v1/responses" == url({"base_url": "http://a/v1/responses", "api_type": "responses"})
    with pytest.raises(ValueError):
        Endpoint.of({"base_url": "http://a"})
    made = Endpoint.of({"base_url": "http://a", "api_key": "k", "max_tokens": 5, "temperature": 0, "extra_body": {"a": 1, "b": 1}}, extra={"b": 2}, timeout=7)
    assert made.settings == {"max_tokens": 5, "temperature": 0, "extra": {"a": 1, "b": 2}} and made.timeout == 7


def test_reply_bodies(spark):
    bodies = [
        ('{"choices": [{"message": {"content": "a"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}', "a", 3, 4),
        ('{"output": "", "choices": [{"message": {"content": "a"}}]}', "", 0, 0),
        ('{"output": [], "choices": [{"message": {"content": null, "text": "t"}}]}', "t", 0, 0),
        ('{"output": [{"type": "message", "content": 3}, 5, {"type": "message", "content": [{"type": "text", "text": "z"}]}], "usage": {"input_tokens": 1, "output_tokens": 2}}', "z", 1, 2),
        ('{"output": [{"type": "reasoning", "content": [{"type": "text", "text": "z"}]}]}', 'Error: No choices in response. Raw: {"output": [{"type": "reasoning", "content": [{"type": "text", "text": "z"}]}]}', 0, 0),
        ('{"choices": [{"message": {"content": 5}}]}', "", 0, 0), ("[1]", None, 0, 0), ("nonsense", None, 0, 0), (None, None, 0, 0),
    ]
    t = spark.createDataFrame([(i, b[0]) for i, b in enumerate(bodies)], "i int, b string")
    got = t.select("i", payloads.reply_text(F.col("b")).alias("r"), payloads.usage(F.col("b")).alias("u")).orderBy("i").collect()
    assert [(r["r"], *r["u"]) for r in got] == [b[1:] for b in bodies]


@pytest.mark.parametrize("dialect", ["chat", "responses"])
def test_endpoint_over_http(spark, dialect):
    """A server that is busy at first, echoes the prompt, and refuses one for good."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["input"] if dialect == "responses" else body["messages"][-1]["content"][0]["text"]
            seen.append((prompt, self.headers["Authorization"], self.path))
            code = 400 if prompt == "refused" else 503 if sum(p == prompt for p, *_ in seen) == 1 else 200
            reply = {"output": [{"type": "message", "content": [{"type": "output_text", "text": prompt + "!"}]}]} if dialect == "responses" else {"choices": [{"message": {"content": prompt + "!"}}]}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(reply | {"usage": {"prompt_tokens": 5, "completion_tokens": 6}}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        endpoint = Endpoint.of({"base_url": f"http://127.0.0.1:{server.server_port}/v1", "api_key": "k", "api_type": dialect}, wait=0.01)
        prompts = spark.createDataFrame([(1, "m", "hello"), (2, "m", "refused")], "request_id long, model string, prompt string")
        got = {r["request_id"]: r for r in call_models(prompts, endpoint).collect()}
    finally:
        server.shutdown()
    assert (got[1]["response"], got[1]["status"], got[1]["input_tokens"], got[1]["output_tokens"]) == ("hello!", "ok", 5, 6)
    assert got[2]["status"] == "failed" and got[2]["error"].startswith("Request failed: HTTP Error 400") and got[2]["input_tokens"] == 0
    assert [p for p, *_ in seen].count("hello") == 2 and [p for p, *_ in seen].count("refused") == 1
    assert {(a, p) for _, a, p in seen} == {("Bearer k", "/v1/responses" if dialect == "responses" else "/v1/chat/completions")}


def _requests(spark, n):
    t = spark.range(n).select(F.col("id").alias("request_id"), F.lit("m").alias("model"), F.concat(F.lit("p"), "id").alias("prompt"))
    return t.withColumn("prompt_sha256", F.sha2("prompt", 256))


def test_killed_run_goes_on_where_it_was(spark, tmp_path):
    """The worker dies at the first call of the third slice; the next run sends exactly what wasn't committed."""
    sent, stop, path = tmp_path / "sent", tmp_path / "stop", str(tmp_path / "log")
    requests = _requests(spark, 120)
    sizes = [r["n"] for r in Completions(None, path, every=30).slices(requests, 120).groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect()]
    assert len(sizes) == 4
    stop.write_text(str(sum(sizes[:2])))

    def make():
        def call(prompt, model):
            before = sent.read_text().count("\n") if sent.exists() else 0
            if stop.exists() and before >= int(stop.read_text()):
                os._exit(1)
            with open(sent, "a") as f:
                f.write(prompt + "\n")
            return "r" + prompt

        return call

    with pytest.raises(Exception, match="(?s)."):
        Completions(make, path, every=30, tasks=1, threads=1).complete(requests)
    committed = {r["prompt_sha256"] for r in Completions(make, path).read(spark).collect()}
    assert len(committed) == sum(sizes[:2])
    stop.unlink()
    got = Completions(make, path, every=30).complete(requests).collect()
    assert sorted((r["request_id"], r["response"], r["status"]) for r in got) == [(i, f"rp{i}", "ok") for i in range(120)]
    lines = sent.read_text().split()
    assert len(lines) == len(set(lines)) == 120  # no prompt was sent twice
    assert Completions(make, path).complete(requests).count() == 120 and len(sent.read_text().split()) == 120


def test_failed_and_forced_calls(spark, tmp_path):
    path, requests = str(tmp_path / "log"), _requests(spark, 3)

    def down():
        def call(prompt, model):
            if prompt == "p1":
                raise OSError("down")
            return "first", 2, 3

        return call

    up = lambda: lambda prompt, model: ("second", 20, 30)
    run = lambda **more: {r["request_id"]: (r["status"], r["response"]) for r in Completions(path=path, **more).complete(requests).collect()}
    assert run(make=down) == {0: ("ok", "first"), 1: ("failed", None), 2: ("ok", "first")}
    assert run(make=up) == {0: ("ok", "first"), 1: ("failed", None), 2: ("ok", "first")}  # failed ones count as done
    assert run(make=up, retry_failed=True) == {0: ("ok", "first"), 1: ("ok", "second"), 2: ("ok", "first")}
    assert run(make=up, force=True) == {i: ("ok", "second") for i in range(3)}
    assert run(make=down) == {i: ("ok", "second") for i in range(3)}
    told = usage(Completions(down, path).log(spark)).first()
    assert (told["calls"], told["failed"], told["input_tokens"], told["output_tokens"]) == (7, 1, 2 * 2 + 4 * 20, 2 * 3 + 4 * 30)
    assert Completions(up, path).complete(requests.limit(0)).count() == 0


def test_evaluation_resumes(spark, tiny):
    """What an earlier run said stays, failed or not; with force all is said anew; other models' responses stay."""
    items = mq._items(spark, tiny)
    whole = passes.evaluate(items, ["m0", "m1"], "judge", mq.PROMPTS, mq.make)
    marked = whole.where("model = 'm0'").withColumn("answer", F.lit("kept")).withColumn("status", F.lit("failed"))
    other = marked.limit(1).withColumn("model", F.lit("m9"))
    keyed = lambda df: {(r["category"], r["item_index"], r["model"]): (r["answer"], r["status"]) for r in df.collect()}
    new, before = keyed(whole), keyed(marked) | keyed(other)
    assert keyed(passes.evaluate(items, ["m0", "m1"], "judge", mq.PROMPTS, mq.make, existing=marked.unionByName(other))) == new | before
    assert keyed(passes.evaluate(items, ["m0", "m1"], "judge", mq.PROMPTS, mq.make, existing=marked.unionByName(other), force=True)) == new | keyed(other)


def test_risks_resume(spark, tiny):
    answers = mq._items(spark, tiny).where("category = 'CBQ'").withColumn("model", F.lit("m")).withColumn("answer", F.lit("a"))
    judge = lambda **more: passes.judge_risks(answers, "j", "RISK {question} {answer}", mq.make, **more)
    keyed = lambda df: {(r["item_index"], r["model"]): (r["risk_level"], r["reason"]) for r in df.collect()}
    whole = keyed(judge())
    first = judge().withColumn("reason", F.lit("kept"))
    assert keyed(judge(existing=first)) == {k: (v[0], "kept" if v[0] else v[1]) for k, v in whole.items()}
    assert keyed(judge(existing=first, force=True)) == whole
    assert "" in {v[0] for v in whole.values()}
    told = judge().first()
    assert told["judge_config"] == "j" and told["tagged_at"].endswith("+00:00")
