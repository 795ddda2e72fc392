"""What is left to do, and keyed updates of what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.functions import values as V
from quizloom.sources.scratch import store

ITEM = ["category", "item_index"]


def pending_evaluations(items: DataFrame, models: list[str], responses: DataFrame, force: bool = False) -> DataFrame:
    """Items times models, without the pairs that have a response, failed ones included.  models: the names of a run."""
    wanted = items.select(*ITEM, F.explode(F.array(*map(F.lit, models)).cast("array<string>")).alias("model"))
    return wanted if force else wanted.join(responses.select(*ITEM, "model"), [*ITEM, "model"], "left_anti")


def pending_risks(responses: DataFrame, models: list[str], force: bool = False) -> DataFrame:
    """Answered CBQ responses of the models whose risk label isn't valid; failed labels are tried again."""
    answered = responses.where((F.col("category") == "CBQ") & F.col("model").isin(models) & T.has_text(F.col("answer")))
    done = T.risk_level(F.col("risk")) != ""
    return (answered if force else answered.where(~done)).select("item_index", "model")


def upsert(history: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key, with position: the key's first version.  Tasks keep one row a key before the shuffle."""
    last = F.max_by(F.struct(*history.columns), F.struct(version)).alias("_row")
    rows = history.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(last, F.min(version).alias("position"))
    return rows.select("_row.*", "position")


def skip_existing(records: DataFrame, done: DataFrame, key: str = "output_path") -> DataFrame:
    return records.join(done.select(key).distinct(), key, "left_anti")


def with_cached(records: DataFrame, cached: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(records without a cached result), and the cached results of the others; cached: one row a key, with work's columns."""
    fresh = work(skip_existing(records, cached, key))
    return fresh.unionByName(cached.join(records.select(key).distinct(), key, "left_semi").select(*fresh.columns))


def numbered(records: DataFrame, order: str, name: str) -> DataFrame:
    """records with their position in order, from 0, counted within ranges of order, so no task holds all rows.

    The ranges are stored: were they drawn again for the second job, their bounds could differ from those
    that were counted.  Rows that are equal in order go to one range and follow each other there in any order.
    """
    ranged = store(records.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # one number a partition
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(before).cast("bigint")]
        before += sizes[p]
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    offset = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    return inside.withColumn(name, (offset + F.col("_at") - 1).cast("bigint")).drop("_part", "_at")


def deal(records: DataFrame, order: str, n: int) -> DataFrame:
    """Round robin by the position in order."""
    return numbered(records, order, "_position").withColumn("worker", F.pmod(F.col("_position"), F.lit(n)).cast("bigint")).drop("_position")


def progress(log: DataFrame) -> DataFrame:
    """log: rows (stage, status).  Counts by stage and status, and the share that is done."""
    rows = log.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", T.round_half_even(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("stage"))))


def token_usage(completions: DataFrame) -> DataFrame:
    return completions.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def discipline_table(spark) -> DataFrame:
    return spark.createDataFrame(list(V.DISCIPLINES.items()), "number int, name string")


def limited(records: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n records in order; all without a limit, or with one below 1."""
    return records.orderBy(order).limit(n) if n and n > 0 else records


def throughput(log: DataFrame, total: int) -> DataFrame:
    """log: rows (stage, finished_at as seconds).  Of each stage: done, per_second and the seconds that are left at that rate."""
    rows = log.groupBy("stage").agg(F.count(F.lit(1)).alias("done"), (F.max("finished_at") - F.min("finished_at")).cast("double").alias("_s"))
    rate = F.when(F.col("_s") > 0, F.col("done") / F.col("_s"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0)) / rate
    return rows.select("stage", "done", rate.alias("per_second"), left.alias("seconds_left"))
