"""Sinks: JSON, CSV and Markdown reports, and queue items."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.functions import values as V
from quizloom.sources.scratch import delete


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One file with a header and the columns in this order; nulls are empty.  For reports, which have few rows."""
    df.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def markdown_lines(df: DataFrame, columns: list[str]) -> list[str]:
    """A Markdown table of a report (few rows): numbers with two decimals, nulls empty."""
    kinds = dict(df.dtypes)
    cells = [T.two_decimals(F.col(c)) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    rows = [r[0] for r in df.select(F.array(*cells)).collect()]
    if not rows:
        return ["_No records._"]
    return ["| " + " | ".join(x) + " |" for x in [columns, ["---"] * len(columns), *rows]]


def console_table(df: DataFrame, columns: list[str], widest: int = 40) -> str:
    """A report (few rows) as text: columns as wide as their content, numbers to the right."""
    kinds = dict(df.dtypes)
    numeric = {c: kinds[c] in ("double", "bigint", "int") for c in columns}
    cells = [T.truncate_chars(T.two_decimals(F.col(c)) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("")), widest) for c in columns]
    rows = [r[0] for r in df.select(F.array(*cells)).collect()]
    width = [max(len(x[i]) for x in [columns, *rows]) for i in range(len(columns))]
    line = lambda x: "  ".join(v.rjust(w) if numeric[c] else v.ljust(w) for v, w, c in zip(x, width, columns, strict=True)).rstrip()
    return "\n".join([line(columns), "  ".join("-" * w for w in width), *map(line, rows)])


def report_document(title: str, parts: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """A Markdown document with one table under each heading."""
    lines = [f"# {title}", ""]
    for heading, (df, columns) in parts.items():
        lines += [f"## {heading}", "", *markdown_lines(df, columns), ""]
    return "\n".join(lines)


def report_json(parts: dict[str, DataFrame]) -> str:
    """The reports (few rows each) as one JSON object."""
    rows = {name: [json.loads(x) for x in df.toJSON().collect()] for name, df in parts.items()}
    return json.dumps(rows, ensure_ascii=False, indent=2)


def queue_items(records: DataFrame) -> DataFrame:
    """item_id (MD5 of the source path), paths and type: what the question stage reads."""
    return records.select(F.md5("source_path").alias("item_id"), "source_path", "markdown_path", "metadata_path", F.col("Type").alias("type"))


def enqueue(records: DataFrame, landing: str) -> None:
    queue_items(records).write.mode("append").json(landing)


def write_texts(docs: DataFrame, path: str, key: str, text: str) -> None:
    """One folder of text files for each key; for Markdown of documents."""
    docs.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_lists(items: DataFrame, names: Sequence[str], path: str, rest: str = "{}") -> None:
    """items: name, ordinal, item (JSON).  One JSON object: the members of rest, then a list under each name, in order of ordinal.

    The format is one file, so its lines pass through one task, which sorts them on disk and holds none; each item is one line.
    """
    place = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("name"))
    last = F.col("ordinal") == F.max("ordinal").over(Window.partitionBy("name"))
    line = F.concat(F.to_json(F.parse_json("item")), F.when(last, "").otherwise(","))
    lines = items.select(place.alias("a"), F.lit(1).alias("b"), F.col("ordinal").cast("long").alias("c"), line.alias("value"))
    members = json.dumps(json.loads(rest), ensure_ascii=False)[1:-1]
    frame = [(-1, 0, 0, "{" + members + ("," if members else ""))]
    for i, n in enumerate(names):
        frame += [(i, 0, 0, f"{json.dumps(n)}: ["), (i, 2, 0, "]" if i + 1 == len(names) else "],")]
    frame.append((len(names), 0, 0, "}"))
    whole = lines.unionByName(items.sparkSession.createDataFrame(frame, "a int, b int, c long, value string"))
    whole.repartition(1).sortWithinPartitions("a", "b", "c").select("value").write.mode("overwrite").text(path)


def write_benchmark(items: DataFrame, path: str, rest: str = "{}") -> None:
    """items: category, item_index, item (JSON).  A benchmark file, with the members of rest."""
    write_lists(items.select(F.col("category").alias("name"), F.col("item_index").alias("ordinal"), "item"), V.CATEGORIES, path, rest)


def write_run_summary(done: DataFrame, path: str) -> None:
    """done: source_path, status, error and what else a record holds.  A stage's summary: processed_files, and failed_files with source_path and error."""
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    told = F.when(failed, F.to_json(F.struct("source_path", "error"))).otherwise(F.to_json(F.struct(*[c for c in done.columns if c not in ("status", "error")])))
    rows = done.select(F.when(failed, "failed_files").otherwise("processed_files").alias("name"), "source_path", told.alias("item"))
    numbered = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("name").orderBy("source_path")))
    write_lists(numbered, ("processed_files", "failed_files"), path)


def replace_or_remove(df: DataFrame, path: str, columns: list[str]) -> bool:
    """A report as CSV; where it has no rows, an older one at path is removed.  Whether there are rows."""
    if df.isEmpty():
        delete(df.sparkSession, path)
        return False
    write_csv(df, path, columns)
    return True
