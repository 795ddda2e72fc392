"""Assembling a benchmark from run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import replies
from quizloom.functions import text as T
from quizloom.functions import values as V


def failed(status: Column, error: Column) -> Column:
    return F.coalesce(F.lower(T.trim_all(status)) == "failed", F.lit(False)) | F.coalesce(F.length(error) > 0, F.lit(False))


def question_type(named: Column, typed: Column, category: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(typed, F.lit("")), category)


def reason(records: DataFrame) -> Column:
    """Why a record is kept ("passed") or not; columns kind, status, error, question, n_options, answer, points, process, validated.

    process: found, missing or invalid; points: array of contents.  A column object, where there is one, tells what is no JSON object.
    """
    text = T.has_text(F.col("question"))
    choice = text & (F.col("n_options") > 0) & T.has_text(F.col("answer"))
    short = text & T.has_text(F.col("answer"))
    case = text & (F.size("points") > 0) & F.forall("points", T.has_text)
    kind, no = F.col("kind"), lambda c: ~F.coalesce(c, F.lit(False))
    whole = F.coalesce("object", F.lit(False)) if "object" in records.columns else F.lit(True)
    return (
        F.when(~whole, "not_json_object")
        .when(failed(F.col("status"), F.col("error")), "failed_record")
        .when((kind == "MCQ") & no(choice), "incomplete_mcq")
        .when((kind == "SAQ") & no(short), "incomplete_saq")
        .when(kind.isin("MCQ", "SAQ"), "passed")
        .when((kind == "CaseReport") & no(case), "incomplete_case_report")
        .when((kind == "CaseReport") & (F.col("process") == "missing"), "missing_case_process")
        .when((kind == "CaseReport") & (F.col("process") == "invalid"), "invalid_case_process")
        .when((kind == "CaseReport") & no(F.col("validated")), "validation_not_passed")
        .when(kind == "CaseReport", "passed")
        .otherwise(F.concat(F.lit("unsupported_type:"), F.coalesce(kind, F.lit(""))))
    )


def json_records(rows: DataFrame, *keys: str) -> DataFrame:
    """rows: keys, category, item (JSON text).  The records as reason() takes them, without process and validated, which sidecars tell.

    Members of another type than text count as missing.
    """
    v = F.col("_v")
    text = lambda n: F.when(replies.is_text(replies.part(v, f"$.{n}")), F.try_variant_get(v, f"$.{n}", "string"))
    points = F.when(replies.is_list(replies.part(v, "$.key_points")), F.try_variant_get(v, "$.key_points", "array<variant>"))
    content = lambda p: F.when(replies.is_text(replies.part(p, "$.content")), F.try_variant_get(p, "$.content", "string"))
    options = F.when(replies.is_object(replies.part(v, "$.options")), F.size(F.try_variant_get(v, "$.options", "map<string,variant>")))
    return rows.withColumn("_v", F.try_parse_json("item")).select(
        *keys, replies.is_object(v).alias("object"), question_type(text("question_type"), text("Type"), F.col("category")).alias("kind"),
        text("status").alias("status"), replies.said(v, "$.error").alias("error"), text("question").alias("question"), F.coalesce(options, F.lit(0)).alias("n_options"),
        text("answer").alias("answer"), F.transform(points, content).alias("points"), F.lit("missing").alias("process"), F.lit(False).alias("validated"),
    )


def build(records: DataFrame) -> DataFrame:
    """Kept records by output category and position, without bookkeeping fields."""
    kept = records.withColumn("_reason", reason(records)).where("_reason = 'passed'")
    return kept.withColumn("category", T.category(F.col("kind"))).drop("_reason", *V.BOOKKEEPING)


def reasons(records: DataFrame) -> DataFrame:
    return records.groupBy(T.category(F.col("kind")).alias("category"), reason(records).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def validation_passed(selected: Column, candidates: Column) -> Column:
    """The selected candidate passed, or any did."""
    return F.coalesce(selected == 1, F.lit(False)) | F.coalesce(F.exists(candidates, lambda c: c == 1), F.lit(False))


#: Characters of the piece of a name by which a longer source finds it.
PIECE = 8


def _pieces(text: Column, size: int) -> Column:
    """All runs of that many characters, once each; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))))


def names_holding(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (source, file): the first file name that holds each source, which has a character at least.

    A name is told by its pieces: up to PIECE - 1 characters a source is such a piece itself, and
    the first name of each piece is enough.  A longer source meets the names by the one of its
    pieces that the fewest names hold, and is then looked for in them.
    """
    names = files.select("file").distinct()
    short = sources.select("source").where(F.length("source") < PIECE).distinct()
    every = F.flatten(F.filter(F.array(*[_pieces(F.col("file"), k) for k in range(1, PIECE)]), lambda x: x.isNotNull()))
    first = names.select("file", F.explode(every).alias("source")).groupBy("source").agg(F.min("file").alias("file"))
    by_piece = names.select("file", F.explode(_pieces(F.col("file"), PIECE)).alias("piece"))
    held = by_piece.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    long = sources.select("source").where(F.length("source") >= PIECE).distinct()
    rarest = long.select("source", F.explode(_pieces(F.col("source"), PIECE)).alias("piece")).join(held, "piece", "left")
    rarest = rarest.groupBy("source").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece"))
    found = rarest.join(by_piece, "piece").where(F.contains("file", "source")).groupBy("source").agg(F.min("file").alias("file"))
    return short.join(first, "source").select("source", "file").unionByName(found)


def match_sidecars(cases: DataFrame, sidecars: DataFrame) -> DataFrame:
    """cases: id, seed, source; sidecars: file, seed.  The first file with the case's seed question, or whose name holds its source.

    Equal seeds are an equi-join with the first file of each seed.
    """
    equal = cases.select("id", "seed").join(sidecars.groupBy("seed").agg(F.min("file").alias("file")), "seed").select("id", "file")
    named = cases.where(T.has_text(F.col("source"))).select("id", T.trim_all(F.col("source")).alias("source"))
    by_name = named.join(names_holding(named, sidecars), "source").select("id", "file")
    first = equal.unionByName(by_name).groupBy("id").agg(F.min("file").alias("file"))
    return cases.select("id").join(first, "id", "left")


def flatten_questions(records: DataFrame) -> DataFrame:
    """One row per question of document records that hold a questions array."""
    return records.select("*", F.posexplode("questions").alias("item_ordinal", "item")).drop("questions")


def merge_summary(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows (question_type, path, ordinal, payload): a fresh row takes the place of the one with its key, others are appended."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    at = F.struct("_new", "ordinal")
    rows = both.groupBy("question_type", "path").agg(F.max_by(F.struct("payload"), at).alias("_last"), F.min(at).alias("_at"))
    return rows.select("question_type", "path", F.col("_at._new").alias("appended"), F.col("_at.ordinal").alias("ordinal"), F.col("_last.payload").alias("payload"))


#: Characters of an error that a fallback record tells.
ERROR_CHARS = 1000


def with_metadata(docs: DataFrame, told: Column, error: Column) -> DataFrame:
    """docs with metadata: what the model told, else empty fields with a warning that holds the error's first characters."""
    names = ("Name", "Date", "Authors", "Brief Description", "Type")
    field = lambda n: F.coalesce(told[n], F.lit("")).alias(n)
    warning = F.when(told.isNull(), F.substring(F.coalesce(error, F.lit("")), 1, ERROR_CHARS)).otherwise("").alias("Metadata Warning")
    return docs.withColumn("metadata", F.struct(*map(field, names), warning))


def attach_tags(items: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """items with the tags of their keys; those without get null."""
    return items.join(tags.select(*keys, "tags"), keys, "left")
