"""Keyword tables: the first keyword of a table that a text holds, in one pass over the text however many keywords there are.

The table is numbered by its priority and broadcast in cuts of bounded size; the tasks
build an Aho-Corasick automaton of a cut.  A text with a keyword of one cut is done,
since all later cuts have later priorities; the others go on to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.operators.tasks import numbered
from quizloom.sources.scratch import store

#: Keywords of a cut, and characters of a keyword; longer ones are refused, so a broadcast is bounded.
CUT, LONGEST = 1 << 18, 1000


def keyword_table(spark: SparkSession, groups: Iterable[tuple[object, Iterable[str]]]) -> DataFrame:
    """Groups (value, keywords) in order of precedence as a table."""
    rows = [(k, str(value), i) for i, (value, words) in enumerate(groups) for k in words]
    return spark.createDataFrame(rows, "keyword string, value string, priority int")


def _scan(shared: Broadcast, names: list[str]) -> Callable:
    """The value of the first keyword in each row's _low; null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words, values = shared.value  # in order of priority
        automaton, always = ahocorasick.Automaton(), len(words)
        for rank, word in enumerate(words):
            if not word:
                always = min(always, rank)
            elif word not in automaton:
                automaton.add_word(word, rank)
        automaton.make_automaton()
        some = len(automaton) > 0

        def first(text: str | None) -> str | None:
            if text is None:
                return None
            best = always
            for _, rank in automaton.iter(text) if some else ():
                if rank < best:
                    best = rank
                    if not best:
                        break
            return values[best] if best < len(words) else None

        for batch in batches:
            found = pa.array([first(t.as_py()) for t in batch.column("_low")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, "_value"])

    return run


def first_keyword(rows: DataFrame, text: str, table: DataFrame, name: str, default: str | None = None) -> DataFrame:
    """rows with a column name: the value of the keyword with the smallest priority (of equal ones, by keyword) that the lower-cased text holds.

    table: keyword, value, priority; an empty keyword is in every text, null ones in none; null texts get the default.
    """
    if not table.where(F.length("keyword") > LONGEST).isEmpty():
        raise ValueError(f"keywords have {LONGEST} characters at most")
    kept = table.where(F.col("keyword").isNotNull()).select(F.lower("keyword").alias("keyword"), F.col("value").cast("string").alias("value"), "priority")
    order = numbered(kept.withColumn("_order", F.struct("priority", "keyword")), "_order", "at").withColumn("cut", F.floor(F.col("at") / CUT))
    order = store(order.select("keyword", "value", "at", "cut"), "keywords")
    names, schema = rows.columns, rows.schema
    left, done = rows.withColumn("_low", F.lower(text)), []
    cuts = [r["cut"] for r in order.select("cut").distinct().orderBy("cut").collect()]  # one row a cut
    for i, cut in enumerate(cuts):
        part = order.where(F.col("cut") == cut).orderBy("at").select("keyword", "value").toArrow()  # CUT rows at most
        shared = rows.sparkSession.sparkContext.broadcast((part.column("keyword").to_pylist(), part.column("value").to_pylist()))
        told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        found = left.mapInArrow(_scan(shared, names), f"{told}, _value string")
        if i + 1 < len(cuts):
            found = store(found, "scanned")
            done.append(found.where(F.col("_value").isNotNull()))
            left = found.where(F.col("_value").isNull()).drop("_value").withColumn("_low", F.lower(text))
        else:
            done.append(found)
    if not cuts:
        done = [rows.withColumn("_value", F.lit(None).cast("string"))]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn(name, F.coalesce("_value", F.lit(default))).drop("_value")
