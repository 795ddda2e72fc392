"""Requests and replies of model endpoints as columns, in both dialects that are in use: chat completions and responses."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizloom.functions import replies

CHAT, RESPONSES = "chat", "responses"
#: The path of each dialect below a base address.
ENDINGS = {CHAT: "/chat/completions", RESPONSES: "/responses"}


def endpoint_url(settings: dict) -> str:
    """Where calls go: url as it is, else base_url with the path of the settings' api_type; empty without either."""
    if settings.get("url"):
        return settings["url"].rstrip("/")
    base = (settings.get("base_url") or "").rstrip("/")
    ending = ENDINGS.get(settings.get("api_type", CHAT), ENDINGS[CHAT])
    return base if not base or base.endswith(ending) else base + ending


def _literal(value: object) -> Column:
    return F.lit(value) if isinstance(value, (str, int, float, bool)) else F.parse_json(F.lit(json.dumps(value)))


def payload(
    model: Column,
    prompt: Column,
    dialect: str = CHAT,
    system: Column | None = None,
    images: Column | None = None,
    json_output: bool = False,
    stream: bool = False,
    max_tokens: int | None = None,
    temperature: float | None = None,
    reasoning_effort: str | None = None,
    extra: dict | None = None,
    only_max_tokens: bool = False,
) -> Column:
    """The request's JSON text; what isn't set is left out, and extra's members take the place of others.

    images: array of data addresses, which only the chat dialect takes, as do json_output and stream.
    """
    system = F.nullif(system, F.lit("")) if system is not None else None
    fields: dict[str, Column] = {"model": model}
    if dialect == RESPONSES:
        fields["input"] = F.coalesce(prompt, F.lit(""))
        numbers = {"max_output_tokens": max_tokens, "temperature": temperature}
        if system is not None:
            fields["instructions"] = system
        if reasoning_effort is not None:
            fields["reasoning"] = F.struct(F.lit(reasoning_effort).alias("effort"))
    else:
        text = F.struct(F.lit("text").alias("type"), F.coalesce(prompt, F.lit("")).alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"))
        parts = F.array(text)
        if images is not None:
            shown = F.transform(images, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url")))
            parts = F.concat(parts, F.coalesce(shown, F.array().cast("array<struct<type:string,text:string,image_url:struct<url:string>>>")))
        messages = F.to_json(F.struct(F.lit("user").alias("role"), parts.alias("content")))
        if system is not None:
            first = F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content")))
            messages = F.when(system.isNotNull(), F.concat(first, F.lit(","), messages)).otherwise(messages)
        fields["messages"] = F.parse_json(F.concat(F.lit("["), messages, F.lit("]")))
        numbers = {"max_tokens": max_tokens, "max_completion_tokens": None if only_max_tokens else max_tokens, "temperature": temperature}
        if reasoning_effort is not None:
            fields["reasoning_effort"] = F.lit(reasoning_effort)
        if json_output:
            fields["response_format"] = F.struct(F.lit("json_object").alias("type"))
        if stream:
            fields["stream"] = F.lit(True)
    fields |= {k: F.lit(v) for k, v in numbers.items() if v is not None}
    fields |= {k: _literal(v) for k, v in (extra or {}).items() if v is not None}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _text(value: Column, path: str) -> Column:
    """The text at path; null where there is none or another type."""
    return F.when(replies.is_text(replies.part(value, path)), F.try_variant_get(value, path, "string"))


def _listed(value: Column, path: str) -> Column:
    """The list at path; empty where there is none."""
    every = F.when(replies.is_list(replies.part(value, path)), F.try_variant_get(value, path, "array<variant>"))
    return F.coalesce(every, F.array().cast("array<variant>"))


def reply_text(body: Column) -> Column:
    """What the model said, from the body of a reply in either dialect; null where the body is no JSON object.

    Output that is a text is taken as it is; of listed output the first text of a message that isn't empty.
    Otherwise it is the first choice's content, else its text; without choices an error with the body.
    """
    v = F.try_parse_json(body)
    messages = F.filter(_listed(v, "$.output"), lambda m: F.coalesce(_text(m, "$.type") == "message", F.lit(False)))
    parts = F.flatten(F.transform(messages, lambda m: _listed(m, "$.content")))
    told = F.filter(parts, lambda p: F.coalesce(_text(p, "$.type").isin("output_text", "text") & (_text(p, "$.text") != ""), F.lit(False)))
    message = replies.part(v, "$.choices[0].message")
    chosen = F.coalesce(F.nullif(_text(message, "$.content"), F.lit("")), _text(message, "$.text"), F.lit(""))
    none = F.concat(F.lit("Error: No choices in response. Raw: "), body)
    plain = F.when(F.size(_listed(v, "$.choices")) > 0, chosen).otherwise(none)
    return F.when(replies.is_object(v), F.coalesce(_text(v, "$.output"), F.when(F.size(told) > 0, _text(F.get(told, F.lit(0)), "$.text")), plain))


def usage(body: Column) -> Column:
    """struct(input_tokens, output_tokens) that the reply tells, under the names of either dialect; 0 where it doesn't."""
    v = F.try_parse_json(body)
    first = lambda *names: F.coalesce(*[F.try_variant_get(v, f"$.usage.{n}", "long") for n in names], F.lit(0).cast("long"))
    return F.struct(first("prompt_tokens", "input_tokens").alias("input_tokens"), first("completion_tokens", "output_tokens").alias("output_tokens"))
