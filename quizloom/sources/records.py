"""Scans and rows of a run's own records: summaries, resume indexes, prompts and settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import text as T

RESUME = ("source_path", "markdown_path", "question_type", "output_path", "process_output_path", "status")


def _entries(payload: Column) -> Column:
    """The members of a JSON object as (key, JSON text); null for anything else."""
    whole = T.trim_all(F.coalesce(payload, F.lit("")))
    return F.when(whole.startswith("{"), F.map_entries(F.from_json(whole, "map<string,string>")))


def _objects(value: Column) -> Column:
    """The elements of a JSON list that are objects, as JSON texts; null where it is no list."""
    every = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>"))
    return F.filter(every, lambda x: F.ltrim(x).startswith("{"))


def summary_items(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows (key, question_type, ordinal, item) of run summaries: lists of objects by type.

    The older list processed_files is dealt by its items' question_type, Unknown without one; a
    type's own list takes its place.
    """
    lists = payloads.select(key, F.explode(_entries(F.col(payload))).alias("e")).select(key, F.col("e.key").alias("name"), _objects(F.col("e.value")).alias("items"))
    lists = lists.where(F.col("items").isNotNull())
    named = lists.where("name <> 'processed_files'").select(key, F.col("name").alias("question_type"), "items")
    own = named.select(key, "question_type", F.posexplode("items").alias("ordinal", "item"))
    older = lists.where("name = 'processed_files'").select(key, F.posexplode("items").alias("at", "item"))
    kind = F.coalesce(F.nullif(F.get_json_object("item", "$.question_type"), F.lit("")), F.lit("Unknown"))
    older = older.withColumn("question_type", kind).join(named.select(key, "question_type"), [key, "question_type"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(key, "question_type").orderBy("at")) - 1
    return own.unionByName(older.select(key, "question_type", nth.alias("ordinal"), "item"))


def resume_index(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows (key, source_path, record) of resume indexes: the member records where there is one, else the whole object.

    Members that are no objects are left out, and of a repeated member the last one stands.  A records member that is no object, null included, has no rows.
    """
    plain = T.trim_all(F.coalesce(payload, F.lit("")))
    has = F.coalesce(F.array_contains(F.json_object_keys(plain), "records"), F.lit(False))
    body = F.when(has, F.get_json_object(plain, "$.records")).otherwise(plain)
    each = payloads.select(key, _entries(body).alias("_all")).select(key, F.posexplode("_all").alias("_at", "e"))
    last = each.groupBy(key, F.col("e.key").alias("source_path")).agg(F.max_by("e.value", "_at").alias("record"))
    return last.where(F.ltrim("record").startswith("{"))


def resume_record(**columns: Column) -> Column:
    """A resume record as JSON; what is missing or null is empty."""
    return F.to_json(F.struct(*[F.coalesce(columns.get(n, F.lit("")).cast("string"), F.lit("")).alias(n) for n in RESUME]))


def write_resume_index(records: DataFrame, path: str) -> None:
    """records: source_path, record (JSON), one row per source.  One line of JSON each, which resume_index reads back."""
    line = F.to_json(F.create_map("source_path", F.parse_json("record")))
    records.select(line.alias("value")).write.mode("overwrite").text(path)


def load_settings(path: str) -> dict:
    """A JSON or YAML file of prompts or settings, which the driver reads; it must hold an object."""
    with open(path, encoding="utf-8") as f:
        if path.lower().endswith(".json"):
            found = json.load(f)
        else:
            import yaml

            found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def model_settings(settings: dict, name: str, default: str = "default") -> dict:
    """The section of that name, else the default one, without a key that is null."""
    section = settings.get(name, settings.get(default))
    if not isinstance(section, dict):
        raise KeyError(f"no settings for {name}")
    return {k: v for k, v in section.items() if v is not None}


def setting(*values: object) -> object:
    """The first that isn't None: what a call says, then the settings, then the default; 0 and an empty text count."""
    return next((v for v in values if v is not None), None)


def count_mode(mode: str | None, tokenizer: str | None, settings: dict) -> str:
    """local or api: as told, else local where there is a tokenizer."""
    return mode if mode in ("local", "api") else "local" if tokenizer or settings.get("tokenizer") else "api"


def benchmark_filename(name: Column, default: str = "benchmark") -> Column:
    """A benchmark's file name; blank names get the default one."""
    trimmed = F.coalesce(F.nullif(T.trim_all(F.coalesce(name, F.lit(""))), F.lit("")), F.lit(default))
    return F.when(trimmed.endswith(".json"), trimmed).otherwise(F.concat(trimmed, F.lit(".json")))


def output_path(markdown: Column, inputs: str, outputs: str, ending: str) -> Column:
    """Where the result of a Markdown file goes: its path below inputs, else its name, below outputs, with another ending."""
    root = inputs.rstrip("/") + "/"
    below = F.when(markdown.startswith(root), F.substring(markdown, F.lit(len(root) + 1), F.length(markdown))).otherwise(F.regexp_extract(markdown, r"([^/]*)$", 1))
    return F.concat(F.lit(outputs.rstrip("/") + "/"), F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", ""), F.lit(ending))
