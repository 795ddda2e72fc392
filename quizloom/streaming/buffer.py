"""The queue between stages as a file stream with checkpointed, keyed results."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quizloom.sources.scratch import exists

QUEUE = "item_id string, source_path string, markdown_path string, metadata_path string, type string"


def queue(spark: SparkSession, landing: str, schema: str = QUEUE, files_per_batch: int = 1000) -> DataFrame:
    """Items of the JSON files in landing, each file once; a line that doesn't parse has null fields and its text in _bad."""
    read = spark.readStream.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad")
    return read.option("maxFilesPerTrigger", files_per_batch).json(landing)


Process = Callable[[DataFrame], DataFrame]
#: One column that tells items apart, or several, the first of which every item has.
Key = str | list[str]


def _keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _work(process: Process, results: str, failed: str, key: Key) -> Callable[[DataFrame, int], None]:
    """A batch's function: process adds status and error; what failed, and lines that didn't parse, go to failed, all others to results."""
    keys = _keys(key)

    def batch(rows: DataFrame, number: int) -> None:
        bad = rows.where(F.col(keys[0]).isNull())
        done = process(rows.where(F.col(keys[0]).isNotNull()).dropDuplicates(keys).drop("_bad")).persist()
        try:
            done.where("status <> 'failed'").write.mode("overwrite").parquet(f"{results}/batch={number}")
            lost = done.where("status = 'failed'").select(F.to_json(F.struct("*")).alias("payload"), "error")
            lost = lost.unionByName(bad.select(F.col("_bad").alias("payload"), F.lit("not JSON").alias("error")))
            lost.write.mode("overwrite").parquet(f"{failed}/batch={number}")
        finally:
            done.unpersist()

    return batch


def drain(items: DataFrame, process: Process, results: str, failed: str, checkpoint: str, key: Key = "item_id") -> StreamingQuery:
    """Works off all items that are there and stops.  Each batch overwrites its own folder, so a batch that is repeated after a loss leaves the same rows."""
    batch = _work(process, results, failed, key)
    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _told(key: Key) -> Column:
    """A line's key as one text; the line itself where it doesn't parse."""
    first, *more = _keys(key)
    return F.coalesce(F.when(F.col(first).isNotNull(), F.to_json(F.struct(first, *more))) if more else F.col(first), F.col("_bad"))


def once(items: DataFrame, key: Key = "item_id", arrived: str | None = None, within: str = "1 day") -> DataFrame:
    """Each key's first item over all batches, by a state that the stream's checkpoint keeps.

    Lines that don't parse are told apart by their text.  With a column arrived (a time), a key is forgotten when it is
    older than within, which bounds the state; without one it holds a hash for every key.
    """
    keyed = items.withColumn("_key", F.xxhash64(_told(key), F.sha2(_told(key), 256)))
    kept = keyed.dropDuplicates(["_key"]) if arrived is None else keyed.withWatermark(arrived, within).dropDuplicatesWithinWatermark(["_key"])
    return kept.drop("_key")


def follow(
    items: DataFrame, process: Process, results: str, failed: str, checkpoint: str, key: Key = "item_id", poll: float = 2.0, idle: float = 20.0,
    done_mark: str | None = None,
) -> str:
    """Works on items as they come until the producer has left its mark, or nothing came for idle seconds; which of the two: done or idle.

    Either way what had come by then is worked off.  A stream that is started again with the same checkpoint goes on where this one ended.
    """
    spark = items.sparkSession
    batch = _work(process, results, failed, key)
    query = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, int(poll * 1000))} milliseconds").start()
    last, seen = time.monotonic(), -1
    try:
        while True:
            time.sleep(poll / 2)
            if query.exception() is not None:
                raise query.exception()
            for p in query.recentProgress:
                if p["batchId"] > seen:
                    seen = p["batchId"]
                    last = time.monotonic() if p["numInputRows"] else last
            done = done_mark is not None and exists(spark, done_mark)
            if done or time.monotonic() - last >= idle and not query.status["isTriggerActive"]:
                query.processAllAvailable()
                return "done" if done else "idle"
    finally:
        query.stop()


def latest(spark: SparkSession, results: str, key: Key = "item_id") -> DataFrame:
    """The newest result of each key over all batches."""
    newest = F.max("batch").over(Window.partitionBy(*_keys(key)))
    return spark.read.parquet(results).withColumn("_newest", newest).where("batch = _newest").drop("_newest")
