"""Question items: validators, first-wins deduplication, candidates and bounded refinement."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import replies
from quizloom.functions import text as T
from quizloom.functions import values as V
from quizloom.sources.scratch import store


def _first_failing(checks: list[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    """The name of the first check that isn't true, else ok."""
    out = F.lit("ok") if otherwise is None else otherwise
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def choice_problem(source: Column, question: Column, options: Column, answer: Column) -> Column:
    """ok, or what is wrong with a multiple-choice item; options (array of key, value) may be missing.

    Two options must have a text and a key, and the answer must be the key of one that does.
    """
    full = F.filter(options, lambda o: T.has_text(o["key"]) & T.has_text(o["value"]))
    return _first_failing(
        [
            ("from", T.has_text(source)), ("question", T.has_text(question)), ("answer", T.has_text(answer)),
            ("options", options.isNull() | (F.size(full) >= 2)),
            ("answer_key", options.isNull() | F.exists(full, lambda o: o["key"] == T.trim_all(answer))),
        ]
    )


def _text(value: Column, name: str) -> Column:
    """The member of that name where it is a text that isn't blank."""
    told = F.when(replies.is_text(replies.part(value, f"$.{name}")), F.try_variant_get(value, f"$.{name}", "string"))
    return F.when(T.has_text(told), told)


def full_options(value: Column) -> Column:
    """The options of an item (VARIANT) whose key and text aren't blank, as a map; null where they are no object."""
    told = F.when(replies.is_object(replies.part(value, "$.options")), F.try_variant_get(value, "$.options", "map<string,variant>"))
    texts = F.transform_values(told, lambda k, x: F.when(replies.is_text(x), F.try_variant_get(x, "$", "string")))
    return F.map_filter(texts, lambda k, x: T.has_text(k) & T.has_text(x))


def item_problem(item: Column, kind: str) -> Column:
    """ok, or what is wrong with an item's JSON text by the types of its members.  kind: MCQ, SAQ or CaseReport.

    Options of a multiple-choice item may be missing or null, but what is there must be an object.
    """
    v = F.try_parse_json(item)
    if kind == "CaseReport":
        return F.when(~replies.is_object(v), "not_an_object").otherwise(_case_item_problem(v))
    options = replies.is_missing(replies.part(v, "$.options"))
    reason = replies.part(v, "$.reason")
    checks = [(n, _text(v, n).isNotNull()) for n in ("from", "question", "answer")]
    if kind == "MCQ":
        checks += [("options", options | (F.size(full_options(v)) >= 2)), ("answer_key", options | F.map_contains_key(full_options(v), T.trim_all(_text(v, "answer"))))]
    else:
        checks.append(("options_present", ~F.array_contains(F.json_object_keys(item), "options")))
    checks.append(("reason", replies.is_missing(reason) | replies.is_text(reason)))
    return F.when(~replies.is_object(v), "not_an_object").otherwise(_first_failing(checks))


def _case_item_problem(v: Column) -> Column:
    names = ("location", "explanation")
    seed = replies.part(v, "$.seed_question")
    points = F.when(replies.is_list(replies.part(v, "$.key_points")), F.try_variant_get(v, "$.key_points", "array<variant>"))
    whole = lambda p: replies.is_object(p) & reduce(lambda a, b: a & b, [_text(p, n).isNotNull() for n in ("content", *names)])
    bad = F.array_position(F.transform(points, whole), False)
    checks = [("seed_question", replies.is_object(seed)), *[(f"seed_question.{n}", _text(seed, n).isNotNull()) for n in ("question", *names)]]
    rest = F.coalesce(F.concat(F.lit("key_point_"), F.nullif(bad, F.lit(0).cast("long")).cast("string")), F.lit("ok"))
    return _first_failing([*checks, ("five_key_points", F.size(points) == V.KEY_POINTS)], rest)


def short_answer_problem(source: Column, question: Column, answer: Column, keys: Column) -> Column:
    """keys: the item's keys; options must be absent, null included."""
    return _first_failing(
        [
            ("from", T.has_text(source)), ("question", T.has_text(question)), ("answer", T.has_text(answer)),
            ("options_present", ~F.array_contains(keys, "options")),
        ]
    )


def case_problem(source: Column, seed: Column, points: Column) -> Column:
    """seed: struct(question, location, explanation); points: array of struct(content, location, explanation), five."""
    fields = lambda p, names: reduce(lambda a, b: a & b, [T.has_text(p[n]) for n in names])
    names = ("content", "location", "explanation")
    bad = F.array_position(F.transform(points, lambda p: fields(p, names)), False)
    checks = [("from", T.has_text(source)), ("seed_question", fields(seed, ("question", *names[1:]))), ("five_key_points", F.size(points) == 5)]
    return F.when(_first_failing(checks) != "ok", _first_failing(checks)).when(bad > 0, F.concat(F.lit("key_point_"), bad.cast("string"))).otherwise("ok")


def valid_tags(number: Column, level: Column) -> Column:
    return F.coalesce((number != 0) & level.isin("L1", "L2", "L3"), F.lit(False))


def dedup_first(items: DataFrame, keys: list[str], question: str, order: str) -> DataFrame:
    """The first item of each normalised question within keys; blank questions go.

    Questions meet by their SHA-256, and tasks keep the first of each before anything is shuffled, so a question that
    many items share is one row a task.
    """
    rows = items.withColumn("_q", T.normalize_question(F.col(question))).where(F.col("_q") != "")
    first = F.min_by(F.struct(*items.columns), F.struct(order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.sha2("_q", 256).alias("_sha")).agg(first).select("_row.*")


def validation(c: Column, e: Column, a: Column) -> Column:
    """struct(overall_passed, total_score) of three criteria, each 0 or 1."""
    c, e, a = (F.when(x == 1, 1).otherwise(0) for x in (c, e, a))
    return F.struct(F.least(c, e, a).alias("overall_passed"), (c + e + a).alias("total_score"))


def best_candidate(candidates: DataFrame, key: str, passed: str, total: str, order: str) -> DataFrame:
    """The best by (passed, total), both numbers, the earliest among equals; tasks keep the best of each key before the shuffle."""
    least = F.struct(F.col(passed).isNull(), -F.col(passed), F.col(total).isNull(), -F.col(total), order)
    rows = candidates.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*candidates.columns), least).alias("_row"))
    return rows.select("_row.*")


def refine(candidates: DataFrame, ok: Column, again: Callable[[DataFrame, int], DataFrame], rounds: int = 3) -> DataFrame:
    """Rows that aren't ok go through again(rows, round) up to rounds times; all rows come back, with attempts.

    Each round is stored, so what it calls (a model, say) runs once; the rounds end early when all rows are ok.
    """
    now = candidates.withColumn("attempts", F.lit(0))
    done = []
    for i in range(1, rounds + 1):
        done.append(now.where(ok))
        left = now.where(~F.coalesce(ok, F.lit(False)))
        now = store(again(left, i).withColumn("attempts", F.lit(i)), f"round-{i}")
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, now])
