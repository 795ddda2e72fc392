"""Passes over a model: generation with repair, structure analysis, tagging, cases, evaluation and risk judging.

Every pass renders prompts in Spark, sends each distinct prompt once, stores the replies and reads
them as columns.  A call that failed leaves its row, with status and error.  With a Completions log in place
of the client, a pass that is run again asks only for what the log doesn't hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import replies
from quizloom.functions import text as T
from quizloom.functions import values as V
from quizloom.operators import questions, tasks
from quizloom.operators.completions import Completions
from quizloom.operators.convert import description
from quizloom.operators.model_calls import Client, Endpoint, call_models
from quizloom.sources.scratch import store

Make = Callable[[], Client] | Endpoint | Completions


def ask(rows: DataFrame, prompt: Column, model: Column, make: Make, attempt: int = 1) -> DataFrame:
    """rows with reply, status and error of their prompts; a null prompt counts as empty.

    attempt: a later one has a key of its own, so a log doesn't answer it with the reply of the one before.
    """
    asked = rows.withColumn("_prompt", F.coalesce(prompt, F.lit(""))).withColumn("_model", model)
    asked = asked.withColumn("_sha", F.sha2(F.col("_prompt") if attempt == 1 else F.concat("_prompt", F.lit(f"\n#{attempt}")), 256))
    requests = asked.select(F.col("_model").alias("model"), F.col("_prompt").alias("prompt"), F.col("_sha").alias("prompt_sha256")).distinct()
    requests = requests.select(F.xxhash64("model", "prompt").alias("request_id"), "model", "prompt", "prompt_sha256")
    got = make.complete(requests) if isinstance(make, Completions) else store(call_models(requests, make), "completions")
    got = got.select(F.col("model").alias("_m"), F.col("prompt_sha256").alias("_p"), F.col("response").alias("reply"), "status", "error")
    rows = asked.drop("_prompt", *{"reply", "status", "error"} & set(rows.columns))
    return rows.join(got, (F.col("_model") == F.col("_m")) & (F.col("_sha") == F.col("_p")), "left").drop("_model", "_sha", "_m", "_p")


def evaluate(
    items: DataFrame, models: list[str], judge: str, prompts: dict[str, str], make: Make, existing: DataFrame | None = None, force: bool = False
) -> DataFrame:
    """items: category, item_index, question, options (one text), answer, points (one text).  A response for each item and model.

    prompts: MCQ, SAQ and CBQ for the models, judge_SAQ and judge_CBQ for the judge.  A multiple-choice
    answer is the letter that was chosen; others are judged in a second pass.  existing: responses of
    earlier runs; they stay, failed ones included, and only pairs without one are evaluated, or with force all pairs of
    these models.  Responses of other models and items stay in any case.
    """
    each = items.withColumn("model", F.explode(F.array(*map(F.lit, models)).cast("array<string>")))
    if existing is None:
        return _evaluate(each, judge, prompts, make)
    keys = ["category", "item_index", "model"]
    pending = tasks.pending_evaluations(items, models, existing, force)
    fresh = store(_evaluate(each.join(pending, keys), judge, prompts, make), "evaluated")
    return existing.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns).unionByName(fresh)


def _evaluate(each: DataFrame, judge: str, prompts: dict[str, str], make: Make) -> DataFrame:
    """each: items with the model that is to answer."""
    parts = {"question": F.col("question"), "options": F.col("options"), "answer": F.col("answer"), "points": F.col("points")}
    of = lambda kinds, head="", **more: _by_category({k: T.render(prompts[head + k], **parts, **more) for k in kinds})
    answered = store(ask(each, of(("MCQ", "SAQ", "CBQ")), F.col("model"), make), "answers")
    keys = ["category", "item_index", "model"]
    failed = F.coalesce(F.col("status") == "failed", F.lit(True))
    none = replies.judge(F.lit(None).cast("string"))
    chosen = answered.where((F.col("category") == "MCQ") | failed)
    answer = F.when(~failed, F.when(F.col("category") == "MCQ", T.option_letter(F.col("reply"))))
    chosen = chosen.select(*keys, answer.alias("answer"), F.when(F.lit(False), none).alias("judge"), "status", "error")
    told = answered.where((F.col("category") != "MCQ") & ~failed).withColumn("said", F.coalesce("reply", F.lit("")))
    judged = ask(told, of(("SAQ", "CBQ"), "judge_", model_answer=F.col("said")), F.lit(judge), make)
    ok = F.col("status") == "ok"
    judged = judged.select(*keys, F.when(ok, F.col("said")).alias("answer"), F.when(ok, replies.judge(F.col("reply"))).alias("judge"), "status", "error")
    return chosen.unionByName(judged)


def describe(docs: DataFrame, prompt: str, model: str, make: Make) -> DataFrame:
    """docs: path, text.  path and the metadata fields that the model tells of the first words, else those that path and text tell, with a warning."""
    rendered = T.render(prompt, path=F.col("path"), text=T.truncate_words(F.coalesce("text", F.lit("")), V.METADATA_WORDS))
    asked = ask(docs.select("path", "text"), rendered, F.lit(model), make)
    failed = F.concat(F.lit("Request failed: "), F.coalesce("error", F.lit("")))
    reply = F.when(F.col("status") == "ok", F.col("reply")).otherwise(failed)
    return asked.select("path", description(reply, F.col("path"), F.coalesce("text", F.lit(""))).alias("d")).select("path", "d.*")


def _by_category(columns: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for category, c in columns.items():
        out = F.when(F.col("category") == category, c).otherwise(out)
    return out


def judge_risks(answers: DataFrame, judge: str, prompt: str, make: Make, existing: DataFrame | None = None, force: bool = False) -> DataFrame:
    """answers: item_index, model, question, points, answer.  Each with risk_level, reason, status, error, judge_config and tagged_at (UTC).

    existing: what an earlier run returned.  Its valid levels stay unless force; failed ones are judged again.
    """
    keys = ["item_index", "model"]
    if existing is not None:
        kept = existing.where(F.coalesce(F.col("risk_level") != "", F.lit(False)))
        todo = answers if force else answers.join(kept.select(*keys), keys, "left_anti")
        fresh = store(judge_risks(todo, judge, prompt, make), "judged")
        return existing.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns).unionByName(fresh)
    rendered = T.render(prompt, question=F.col("question"), points=F.col("points"), answer=F.col("answer"))
    asked = ask(answers, rendered, F.lit(judge), make)
    risk = F.when(F.col("status") == "ok", replies.risk(F.col("reply")))
    told = asked.withColumn("risk", risk)
    return told.select(
        *keys, F.coalesce("risk.risk_level", F.lit("")).alias("risk_level"), "risk.reason",
        F.coalesce("risk.status", F.lit("failed")).alias("status"), F.coalesce("risk.error", "error").alias("error"), F.lit(judge).alias("judge_config"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("tagged_at"),
    )


def _fields(item: Column, kind: str) -> tuple[Column, Column]:
    """The item's JSON as a struct, and what is wrong with it."""
    v = F.try_parse_json(item)
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    pairs = F.transform(F.map_entries(questions.full_options(v)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    fields = F.struct(text("from").alias("from"), text("question").alias("question"), pairs.alias("options"), text("answer").alias("answer"), text("reason").alias("reason"))
    return fields, questions.item_problem(item, kind)


def generate(chunks: DataFrame, key: str, kind: str, prompts: dict[str, str], model: str, make: Make) -> tuple[DataFrame, DataFrame]:
    """chunks: key, chunk_index, text.  Items of all chunks (key, chunk_index, nth, repaired, fields), and the chunks that failed (with error).

    A reply must be a list; an item with something wrong is sent back once with its text (prompts: generate, repair)
    and dropped if that doesn't mend it.  Of equal questions of a key the first stays.
    """
    asked = store(ask(chunks, T.render(prompts["generate"], text=F.col("text")), F.lit(model), make), "generated")
    made = asked.withColumn("_items", F.when(F.col("status") == "ok", replies.listed_items(F.col("reply"))))
    failed = made.where(F.col("_items").isNull()).select(key, "chunk_index", F.coalesce("error", F.lit("no JSON list")).alias("error"))
    every = made.where(F.col("_items").isNotNull()).select(key, "chunk_index", "text", F.posexplode("_items").alias("nth", "item"))
    wrong = _fields(F.col("item"), kind)[1]
    mended = ask(every.where(wrong != "ok"), T.render(prompts["repair"], text=F.col("text"), item=F.col("item")), F.lit(model), make)
    mended = mended.select(key, "chunk_index", "nth", F.lit(True).alias("repaired"), F.when(F.col("status") == "ok", T.strip_json_fence(F.col("reply"))).alias("item"))
    good = every.where(wrong == "ok").select(key, "chunk_index", "nth", F.lit(False).alias("repaired"), "item").unionByName(mended.where(wrong == "ok"))
    rows = good.select(key, "chunk_index", "nth", "repaired", _fields(F.col("item"), kind)[0].alias("fields"))
    rows = rows.withColumn("_question", F.col("fields.question")).withColumn("_order", F.struct("chunk_index", "nth"))
    return questions.dedup_first(rows, [key], "_question", "_order").drop("_question", "_order"), failed


def analyse(chunks: DataFrame, prompt: str, model: str, make: Make) -> DataFrame:
    """chunks (with text) and structure: what the model tells of each chunk, with empty values where it doesn't."""
    asked = ask(chunks, T.render(prompt, text=F.col("text")), F.lit(model), make)
    return asked.withColumn("structure", replies.structure(F.when(F.col("status") == "ok", F.col("reply")))).drop("reply", "status", "error")


def tag(items: DataFrame, prompt: str, model: str, make: Make, tries: int = 3) -> DataFrame:
    """items (with text) and tags: struct(number, name, level), of the first try that is valid, else what the text's keywords say."""
    return _tag(items, T.render(prompt, text=F.col("text")), [], model, make, tries)


def _tag(items: DataFrame, rendered: Column, context: list[Column], model: str, make: Make, tries: int) -> DataFrame:
    where = F.concat_ws("\n", rendered, *context)

    def parse(reply: Column) -> Column:
        return T.parse_tags(F.coalesce(reply, F.lit("")), where)

    def again(rows: DataFrame, i: int) -> DataFrame:
        asked = ask(rows, rendered, F.lit(model), make, attempt=i)
        return asked.withColumn("tags", parse(F.col("reply"))).withColumn("said", F.col("status") == "ok").drop("reply", "status", "error")

    start = items.withColumn("tags", parse(F.lit(""))).withColumn("said", F.lit(False))
    ok = F.col("said") & questions.valid_tags(F.col("tags.number"), F.col("tags.level"))
    return questions.refine(start, ok, again, tries).drop("said", "attempts")


#: Candidates that one prompt compares.
LIST = 50


def select_cases(candidates: DataFrame, key: str, prompt: str, model: str, make: Make, most: int = LIST) -> DataFrame:
    """candidates: key, chunk_index, case (JSON), validation.  The one of each key that the model picks from a list of them in order of their chunks.

    A reply that picks none leaves the best by (passed, total score), the earliest among equals.  More than a
    list's worth of chunks is compared in lists of neighbours first, and then their winners, so no task or prompt
    holds more than a list of them.
    """
    now = candidates.withColumn("_slot", F.col("chunk_index"))
    columns = [c for c in candidates.columns if c != key]
    while True:
        last = (now.agg(F.max("_slot")).first()[0] or 0) < most
        lists = now.withColumn("_slot", F.floor(F.col("_slot") / most).cast("int")).groupBy(key, "_slot")
        lists = lists.agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.struct(*columns).alias("row")))).alias("_list"))  # most rows at most
        member = lambda x, name: replies.part(F.try_parse_json(x["row"]["case"]), f"$.{name}").alias(name)
        told = F.transform("_list", lambda x, i: F.struct(i.alias("index"), member(x, "seed_question"), member(x, "key_points"), x["row"]["validation"].alias("validation")))
        lists = store(lists.withColumn("_told", F.to_json(told)), "case-lists")
        alone = lists.where(F.size("_list") == 1).withColumn("_pick", F.lit(0))
        asked = ask(lists.where(F.size("_list") > 1), T.render(prompt, candidates=F.col("_told")), F.lit(model), make)
        best = F.array_max(F.transform("_list", lambda x, i: F.struct(x["row"]["validation"]["overall_passed"].alias("p"), x["row"]["validation"]["total_score"].alias("t"), (-i).alias("i"))))
        pick = F.coalesce(F.when(F.col("status") == "ok", replies.chosen_index(F.col("reply"), F.size("_list"))), -best["i"])
        picked = asked.withColumn("_pick", pick).drop("reply", "status", "error").unionByName(alone)
        now = store(picked.select(key, "_slot", F.get("_list", F.col("_pick"))["row"].alias("_row")), "picked")
        now = now.select(key, "_slot", *[F.col(f"_row.`{c}`") for c in columns])
        if last:
            return now.select(*candidates.columns)


def cases(docs: DataFrame, key: str, prompts: dict[str, str], model: str, make: Make, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """docs: key, chunk_index, text.  The case of each key (chunk_index, case, rounds, validation), and the keys without one (with error).

    A case is written for each chunk (prompts: generate), judged (validate) and written anew from what was found (refine)
    until it passes, up to rounds times.  A reply must be an object with a seed question and its key points:
    another first reply is no candidate, and another later one ends its chunk.  Of the candidates that passed the model picks one (select).
    """

    def told(asked: DataFrame) -> DataFrame:
        """asked with _case: the reply's object as JSON text, where it is a case."""
        rows = asked.withColumn("_item", F.when(F.col("status") == "ok", T.strip_json_fence(F.col("reply"))))
        case = F.when(questions.item_problem(F.col("_item"), "CaseReport") == "ok", F.col("_item"))
        return store(rows.withColumn("_case", case).drop("_item", "reply", "status", "error"), "told")

    def judged(rows: DataFrame) -> DataFrame:
        asked = ask(rows, T.render(prompts["validate"], text=F.col("text"), case=F.col("case")), F.lit(model), make)
        return asked.withColumn("validation", replies.validation(F.when(F.col("status") == "ok", F.col("reply")))).drop("reply", "status", "error")

    def again(rows: DataFrame, i: int) -> DataFrame:
        why = F.to_json("validation")
        asked = ask(rows.drop("attempts"), T.render(prompts["refine"], text=F.col("text"), case=F.col("case"), why=why), F.lit(model), make)
        anew = told(asked)
        over = anew.where(F.col("_case").isNull()).drop("_case").withColumn("over", F.lit(True))
        return judged(anew.where(F.col("_case").isNotNull()).withColumn("case", F.col("_case")).drop("_case", "validation")).unionByName(over)

    first = ask(docs.select(key, "chunk_index", "text"), T.render(prompts["generate"], text=F.col("text")), F.lit(model), make)
    first = told(first).where(F.col("_case").isNotNull()).withColumnRenamed("_case", "case")
    first = store(judged(first).withColumn("over", F.lit(False)), "cases")
    passed = F.col("validation.overall_passed") == 1
    done = questions.refine(first, passed | F.col("over"), again, rounds).withColumnRenamed("attempts", "rounds")
    good = store(done.where(passed).select(key, "chunk_index", "case", "rounds", "validation"), "candidates")
    chosen = select_cases(good, key, prompts["select"], model, make)
    none = docs.select(key).distinct().join(good.select(key).distinct(), key, "left_anti")
    return chosen, none.withColumn("error", F.lit("No valid Case Report candidate could be generated."))


def tag_cases(cases: DataFrame, prompt: str, model: str, make: Make, tries: int = 3) -> DataFrame:
    """cases (case as JSON text; metadata, one text, if there is such a column) and tags.

    The prompt shows the seed question; what keywords are looked for in is the prompt, the key points and the metadata.
    """
    v = F.try_parse_json("case")
    seed = T.trim_all(replies.said(v, "$.seed_question.question"))
    points = F.coalesce(F.to_json(replies.part(v, "$.key_points")), F.lit("[]"))
    context = [points, F.coalesce("metadata", F.lit("{}"))] if "metadata" in cases.columns else [points]
    return _tag(cases, T.render(prompt, question=seed), context, model, make, tries)
