"""Scores, risk labels and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import replies
from quizloom.functions import text as T
from quizloom.functions import values as V


def positive(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a judge's score, told as text, says yes: true, the number one, or a word for yes.  Text "1.0" doesn't."""
    return F.coalesce(F.lower(T.trim_all(c)).isin("1", "true", "yes", "correct", *extra), F.lit(False))


def hit(c: Column) -> Column:
    return positive(c, ("hit",))


def response_letter(c: Column) -> Column:
    """The option letter of a stored response: of the answer where it is an object, none where that failed, else of the text."""
    v = F.try_parse_json(c)
    told = F.when(replies.said(v, "$.status") == "failed", F.lit("")).otherwise(replies.said(v, "$.answer"))
    return T.option_letter(F.when(replies.is_object(v), told).otherwise(c))


def choice_score(reference: Column, answer: Column) -> Column:
    right = T.option_letter(reference)
    return F.when((right != "") & (right == T.option_letter(answer)), 100.0).otherwise(0.0)


def judge_score(score: Column) -> Column:
    return F.when(positive(score), 100.0).otherwise(0.0)


def key_point_score(hits: Column, score: Column) -> Column:
    """20 for each point that was hit, 100 at most; without a list of points the number told, as a percentage if at most 1."""
    told = score.try_cast("double")
    by_number = F.when(told <= 1, told * 100).otherwise(told)
    by_points = F.least(F.lit(100.0), 20.0 * F.size(F.filter(hits, hit)))
    return F.when(hits.isNotNull(), by_points).otherwise(F.coalesce(by_number, F.lit(0.0)))


def level_of(level: Column, older: Column) -> Column:
    found = F.coalesce(F.nullif(level, F.lit("")), older)
    return F.when(found.isin(*V.LEVELS), found).otherwise(V.UNKNOWN)


def discipline_label(number: Column, name: Column) -> Column:
    return F.when(F.coalesce(number, F.lit(0)) != 0, F.concat(number.cast("string"), F.lit(". "), name)).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit(V.UNKNOWN)))


def score_records(items: DataFrame, responses: DataFrame) -> DataFrame:
    """items: category, item_index, answer, level, number, name; responses: category, item_index, model, answer, judge, hits."""
    both = items.withColumnRenamed("answer", "reference").join(responses, ["category", "item_index"])
    score = (
        F.when(F.col("category") == "MCQ", choice_score(F.col("reference"), F.col("answer")))
        .when(F.col("category") == "SAQ", judge_score(F.col("judge")))
        .otherwise(key_point_score(F.col("hits"), F.col("judge")))
    )
    return both.select(
        "model", "category", "item_index", score.alias("score"), level_of(F.col("level"), F.lit(None)).alias("reasoning_level"),
        F.coalesce(F.nullif(F.col("number"), F.lit(0)).cast("string"), F.lit(V.UNKNOWN)).alias("dental_discipline_number"),
        discipline_label(F.col("number"), F.col("name")).alias("dental_discipline"),
    )


def _macro(means: list[Column]) -> Column:
    known = F.filter(F.array(*means), lambda m: m.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, m: a + m)
    return F.when(F.size(known) > 0, total / F.size(known))


def _summary(grouped, digits: int) -> DataFrame:
    of = lambda c: F.when(F.col("category") == c, F.col("score"))
    return grouped.agg(
        *[F.avg(of(c)).alias(f"_{c}") for c in V.CATEGORIES], *[F.count(of(c)).alias(f"{c}_n") for c in V.CATEGORIES],
        F.avg("score").alias("_micro"), F.count("score").alias("n"),
    )


def report(records: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """Means and counts by category, the mean of the category means (macro) and the mean of all scores (micro)."""
    return _rounded(_summary(records.groupBy(*keys), digits), keys, digits)


def _rounded(rows: DataFrame, keys: list[str], digits: int) -> DataFrame:
    each = [x for c in V.CATEGORIES for x in (T.round_half_even(F.col(f"_{c}"), digits).alias(f"{c}_score"), F.col(f"{c}_n"))]
    macro = T.round_half_even(_macro([F.col(f"_{c}") for c in V.CATEGORIES]), digits)
    return rows.select(*keys, *each, macro.alias("macro_average_score"), T.round_half_even(F.col("_micro"), digits).alias("micro_average_score"), "n")


def all_reports(records: DataFrame, digits: int = 2) -> DataFrame:
    """The overall, level and discipline reports from one pass; grouping tells them apart."""
    keys = ["model", "reasoning_level", "dental_discipline_number", "dental_discipline"]
    sets = [["model"], ["model", "reasoning_level"], ["model", "dental_discipline_number", "dental_discipline"]]
    grouped = records.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    of = lambda c: F.when(F.col("category") == c, F.col("score"))
    rows = grouped.agg(
        *[F.avg(of(c)).alias(f"_{c}") for c in V.CATEGORIES], *[F.count(of(c)).alias(f"{c}_n") for c in V.CATEGORIES],
        F.avg("score").alias("_micro"), F.count("score").alias("n"), F.grouping_id(*keys).cast("bigint").alias("grouping"),
    )
    return _rounded(rows, ["grouping", *keys], digits)


def in_report_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of disciplines sort as numbers, whatever isn't one last."""
    order = [F.coalesce(F.col(k).try_cast("int"), F.lit(999)) if k == "dental_discipline_number" else F.col(k) for k in keys]
    return rows.orderBy(*order)


def risk_distribution(records: DataFrame, digits: int = 2) -> DataFrame:
    """Counts and shares by model; shares are of all answers, and models without any label are left out."""
    count = lambda r: F.count(F.when(F.col("risk_level") == r, 1))
    share = lambda r: T.round_half_even(100.0 * count(r) / F.count(F.lit(1)), digits)
    columns = [x for r in V.RISKS for x in (count(r).alias(f"{r}_n"), share(r).alias(f"{r}_percent"))]
    scored = reduce(lambda a, b: a + b, [count(r) for r in V.RISKS])
    rows = records.groupBy("model").agg(F.count(F.lit(1)).alias("n"), scored.alias("scored_n"), *columns)
    return rows.where("scored_n > 0")


def models_of(responses: DataFrame) -> DataFrame:
    return responses.select("model").distinct().orderBy("model")
