"""Model calls as a batch operator with an interchangeable client.

A client is a function made once per task.  It takes (prompt, model) and returns the
text, or the text with the numbers of tokens that went in and came out.  An Endpoint
takes its place where calls go over HTTP: requests and replies are then columns, and
only the body that is sent and the one that comes back pass through Python.  Calls of
one task run on a few threads, since they wait for a network; a failed call keeps its
row, with status and error.
"""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions import payloads

Client = Callable[[str, str], str | tuple[str, int, int]]
SCHEMA = (
    "request_id long, model string, prompt_sha256 string, response string, status string, error string, "
    "input_tokens long, output_tokens long, called_at timestamp"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
#: Seconds that results of quick calls wait for more.
HELD_SECONDS = 1.0
#: Characters of an error that are kept, calls after which a task hands its results on, and replies of a server that are tried again.
ERROR_CHARS, SLICE, AGAIN = 1000, 48, frozenset({408, 409, 425, 429, 500, 502, 503, 504})


def replay(answers: dict[str, str], default: str = "") -> Callable[[], Client]:
    """A client that answers from a table by the prompt's SHA-256."""
    return lambda: lambda prompt, model: answers.get(hashlib.sha256(prompt.encode()).hexdigest(), default)


@dataclass(frozen=True)
class Endpoint:
    """An HTTP endpoint.  send, for tests: takes the request's body and returns the reply's."""

    url: str
    key: str = ""
    dialect: str = payloads.CHAT
    timeout: float = 300
    tries: int = 3
    wait: float = 1.0
    settings: dict = field(default_factory=dict)  # further arguments of payloads.payload
    send: Callable[[str], str] | None = None

    @staticmethod
    def of(settings: dict, **more) -> Endpoint:
        """From a section of the settings file."""
        url = payloads.endpoint_url(settings)
        if not url or not settings.get("api_key"):
            raise ValueError("settings need an api_key, and a url or base_url")
        kept = {k: settings[k] for k in ("max_tokens", "temperature", "reasoning_effort") if settings.get(k) is not None}
        extra = (settings.get("extra_body") or {}) | (more.pop("extra", None) or {})
        return Endpoint(url, settings["api_key"], settings.get("api_type", payloads.CHAT), settings=kept | ({"extra": extra} if extra else {}), **more)

    def post(self, body: str) -> str:
        """The reply's body; tries again, waiting twice as long each time, where the server is busy or doesn't answer."""
        if self.send is not None:
            return self.send(body)
        request = urllib.request.Request(self.url, body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return answer.read().decode()
            except urllib.error.HTTPError as problem:
                if problem.code not in AGAIN or attempt + 1 == self.tries:
                    raise
            except urllib.error.URLError:
                if attempt + 1 == self.tries:
                    raise
            time.sleep(self.wait * 2**attempt)
        raise ValueError("tries must be positive")


def _in_slices(batches: Iterator[pd.DataFrame], one: Callable, names: list[str], threads: int) -> Iterator[pd.DataFrame]:
    """one(row) of all rows, handed on after a slice if its calls are slow; quick ones wait for more, up to a second."""
    with ThreadPoolExecutor(threads) as pool:
        for b in batches:
            rows, held, since = b.itertuples(), [], time.monotonic()
            while some := list(islice(rows, SLICE)):
                held += pool.map(one, some)
                if time.monotonic() - since > HELD_SECONDS:
                    yield pd.DataFrame(held, columns=names)
                    held, since = [], time.monotonic()
            if held:
                yield pd.DataFrame(held, columns=names)


def _by_client(make: Callable[[], Client], threads: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()

        def one(row) -> tuple:
            digest = row.prompt_sha256
            try:
                told = client(row.prompt or "", row.model)
                text, came, went = (told, None, None) if isinstance(told, str) else told
                return row.request_id, row.model, digest, text, "ok", None, came, went, pd.Timestamp.now("UTC")
            except Exception as problem:  # noqa: BLE001  any failure of a call is a result
                return row.request_id, row.model, digest, None, "failed", str(problem)[:ERROR_CHARS], 0, 0, pd.Timestamp.now("UTC")

        for done in _in_slices(batches, one, COLUMNS, threads):
            yield done.astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    return run


def _by_endpoint(endpoint: Endpoint, threads: int) -> Callable:
    names = ["request_id", "model", "prompt_sha256", "body", "error", "called_at"]

    def one(row) -> tuple:
        try:
            return row.request_id, row.model, row.prompt_sha256, endpoint.post(row.payload), None, pd.Timestamp.now("UTC")
        except Exception as problem:  # noqa: BLE001  any failure of a call is a result
            return row.request_id, row.model, row.prompt_sha256, None, f"Request failed: {problem}"[:ERROR_CHARS], pd.Timestamp.now("UTC")

    return lambda batches: _in_slices(batches, one, names, threads)


def call_models(requests: DataFrame, make: Callable[[], Client] | Endpoint, threads: int = 4) -> DataFrame:
    """requests: request_id, model, prompt, and prompt_sha256 where calls of one prompt are to be told apart."""
    if "prompt_sha256" not in requests.columns:
        requests = requests.withColumn("prompt_sha256", F.sha2(F.coalesce("prompt", F.lit("")), 256))
    if not isinstance(make, Endpoint):
        return requests.select("request_id", "model", "prompt", "prompt_sha256").mapInPandas(_by_client(make, threads), SCHEMA)
    body = payloads.payload(F.col("model"), F.col("prompt"), make.dialect, **make.settings)
    sent = requests.select("request_id", "model", "prompt_sha256", body.alias("payload"))
    got = sent.mapInPandas(_by_endpoint(make, threads), "request_id long, model string, prompt_sha256 string, body string, error string, called_at timestamp")
    got = got.withColumn("response", payloads.reply_text(F.col("body"))).withColumn("used", payloads.usage(F.col("body")))
    problem = F.when(F.col("response").isNull(), F.coalesce("error", F.lit("the reply is no JSON object")))
    return got.select(
        "request_id", "model", "prompt_sha256", "response", F.when(problem.isNull(), "ok").otherwise("failed").alias("status"), problem.alias("error"),
        F.col("used.input_tokens"), F.col("used.output_tokens"), "called_at",
    )


def call_once(requests: DataFrame, done: DataFrame, make: Callable[[], Client] | Endpoint, threads: int = 4) -> DataFrame:
    """Only prompts that have no completion yet are sent; done: completions of earlier runs."""
    asked = requests.withColumn("prompt_sha256", F.sha2("prompt", 256))
    known = done.where("status = 'ok'").select("model", "prompt_sha256", "response").dropDuplicates(["model", "prompt_sha256"])
    fresh = asked.join(known.select("model", "prompt_sha256"), ["model", "prompt_sha256"], "left_anti")
    old = asked.join(known, ["model", "prompt_sha256"])
    none = {n: F.lit(None).cast(t).alias(n) for n, t in (("error", "string"), ("input_tokens", "long"), ("output_tokens", "long"), ("called_at", "timestamp"))}
    old = old.select("request_id", "model", "prompt_sha256", "response", F.lit("ok").alias("status"), *none.values())
    return call_models(fresh, make, threads).select(*COLUMNS).unionByName(old)
