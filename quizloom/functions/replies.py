"""Replies of models as columns: what is no JSON, or of another type than asked for, gets a defined value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizloom.functions import text as T

#: Characters of a reply that are told where it couldn't be read.
JUDGE_REST, RISK_REST = 300, 500
CRITERIA = ("correctness", "difficulty", "answerability")


def parsed(reply: Column) -> Column:
    """The reply as VARIANT, without a fence; null where it is no JSON."""
    return F.try_parse_json(T.strip_json_fence(F.coalesce(reply, F.lit(""))))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def is_object(value: Column) -> Column:
    return _kind(value).startswith("OBJECT")


def is_list(value: Column) -> Column:
    return _kind(value).startswith("ARRAY")


def is_text(value: Column) -> Column:
    return _kind(value) == "STRING"


def is_missing(value: Column) -> Column:
    """Absent, or JSON's null."""
    return _kind(value) == "VOID"


def part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def said(value: Column, path: str) -> Column:
    """The text at path; empty for what is missing, null, false, zero or empty."""
    told = F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))
    return F.when(_kind(part(value, path)).isin("VOID", "BOOLEAN", "BIGINT", "DOUBLE") & told.isin("false", "0", "0.0"), "").otherwise(told)


def is_one(value: Column) -> Column:
    """The number one or true; a text isn't."""
    number = _kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(value, "$", "double") == 1)
    return F.coalesce(number | (_kind(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False))


def judge(reply: Column) -> Column:
    """struct(score, reason, hits): an object as it is, with null hits where it lists no key points; else score 0 and what was said."""
    v = parsed(reply)
    points = F.try_variant_get(v, "$.key_points", "array<struct<hit:string>>")
    rest = F.concat(F.lit("Judge did not return JSON: "), F.substring(F.coalesce(reply, F.lit("")), 1, JUDGE_REST))
    return F.struct(
        F.when(is_object(v), F.try_variant_get(v, "$.score", "string")).otherwise("0").alias("score"),
        F.when(is_object(v), F.try_variant_get(v, "$.reason", "string")).otherwise(rest).alias("reason"),
        F.when(is_object(v), F.transform(points, lambda p: p["hit"])).alias("hits"),
    )


def risk(reply: Column) -> Column:
    """struct(risk_level, reason, status, error) of a risk judge's reply; status is failed where no level was told."""
    v, plain = parsed(reply), F.coalesce(reply, F.lit(""))
    first = lambda *names: F.coalesce(*[F.nullif(said(v, f"$.{n}"), F.lit("")) for n in names], F.lit(""))
    level = T.risk_level(F.when(is_object(v), first("risk_level", "level", "raw_content")).otherwise(plain))
    reason = F.when(is_object(v), first("rationale", "reason")).otherwise(F.substring(plain, 1, RISK_REST))
    bad = F.concat(F.lit("Invalid risk level from judge: "), F.substring(plain, 1, RISK_REST))
    return F.struct(
        level.alias("risk_level"), reason.alias("reason"), F.when(level == "", "failed").otherwise("completed").alias("status"), F.when(level == "", bad).alias("error")
    )


def validation(reply: Column) -> Column:
    """struct(correctness, difficulty, answerability: each score and reasoning; overall_passed, total_score)."""
    v = parsed(reply)
    scores = [F.when(is_one(part(v, f"$.{c}.score")), 1).otherwise(0) for c in CRITERIA]
    each = [F.struct(s.alias("score"), said(v, f"$.{c}.reasoning").alias("reasoning")).alias(c) for c, s in zip(CRITERIA, scores, strict=True)]
    return F.struct(*each, F.least(*scores).alias("overall_passed"), (scores[0] + scores[1] + scores[2]).alias("total_score"))


def structure(reply: Column) -> Column:
    """struct(chunk_summary, global_pairing_hint, recommended_section_titles, sections) with empty values for what is missing."""
    v = parsed(reply)
    listed = lambda name: F.coalesce(F.when(is_list(part(v, f"$.{name}")), F.try_variant_get(v, f"$.{name}", "array<variant>")), F.array().cast("array<variant>"))
    titles = F.filter(F.transform(listed("recommended_section_titles"), lambda t: T.trim_all(F.coalesce(F.try_variant_get(t, "$", "string"), F.lit("")))), lambda t: t != "")
    text = lambda s, name, default="": T.trim_all(F.coalesce(F.nullif(said(s, f"$.{name}"), F.lit("")), F.lit(default))).alias(name)
    sections = F.transform(
        F.filter(listed("sections"), is_object),
        lambda s: F.struct(
            text(s, "section_title"), text(s, "section_type", "other"), text(s, "question_signal"), text(s, "answer_signal"), text(s, "pairing_hint"),
            F.when(is_one(part(s, "$.recommended_for_extraction")), 1).otherwise(0).alias("recommended_for_extraction"),
        ),
    )
    return F.struct(
        said(v, "$.chunk_summary").alias("chunk_summary"), said(v, "$.global_pairing_hint").alias("global_pairing_hint"),
        titles.alias("recommended_section_titles"), sections.alias("sections"),
    )


def chosen_index(reply: Column, n: Column) -> Column:
    """The whole number selected_index of a reply's object, where it is from 0 to n - 1; true and false count as 1 and 0."""
    at = part(parsed(reply), "$.selected_index")
    told = F.when(_kind(at) == "BIGINT", F.try_variant_get(at, "$", "long")).when(_kind(at) == "BOOLEAN", F.try_variant_get(at, "$", "boolean").cast("long"))
    return F.when((told >= 0) & (told < n), told.cast("int"))


def listed_items(reply: Column) -> Column:
    """The elements of a JSON list as JSON texts; null where the reply is no list."""
    v = parsed(reply)
    return F.when(is_list(v), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)))
