"""A log of model calls: an append-only table that every run adds to, so that no prompt is paid for twice.

Calls are keyed by the model and the prompt's SHA-256.  What a run still has to ask is
cut into slices by a hash of the key; each slice is one job, whose calls are committed
to the log together.  A run that is killed loses at most the slice it was at; the next
one reads the log first and asks for the rest.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.operators.model_calls import COLUMNS, SCHEMA, Client, Endpoint, call_models
from quizloom.sources.scratch import delete, new_dir, store

KEY = ["model", "prompt_sha256"]
#: Slices whose prompts are written side by side.
SLICES_AT_ONCE = 16


@dataclass(frozen=True)
class Completions:
    """The log at path.  Takes the place of a client in all passes.

    every: calls that are committed together, about.  Failed calls count as done unless retry_failed; with
    force, what earlier runs logged isn't used, and what this one logs takes its place.
    """

    make: Callable[[], Client] | Endpoint
    path: str
    every: int = 100_000
    retry_failed: bool = False
    force: bool = False
    tasks: int | None = None
    threads: int = 4
    run: int = field(default_factory=time.time_ns)

    def log(self, spark: SparkSession) -> DataFrame:
        """All calls of all runs."""
        schema = f"{SCHEMA}, run long"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path)
        return spark.read.schema(schema).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """One row a key: of the calls that went well, if any did, the last run's."""
        rows = self.log(spark)
        rows = rows.where(F.col("run") >= self.run) if self.force else rows
        names = [c for c in [*COLUMNS, "run"] if c not in KEY]
        best = F.max_by(F.struct(*names), F.struct(F.col("status") == "ok", "run", "called_at"))
        return rows.groupBy(*KEY).agg(best.alias("_call")).select(*KEY, "_call.*")

    def slices(self, requests: DataFrame, pending: int) -> DataFrame:
        """requests with the number of their slice, of about every requests each."""
        k = max(1, -(-pending // self.every))
        return requests.withColumn("slice", F.pmod(F.xxhash64(*KEY), F.lit(k)).cast("int"))

    def known(self, spark: SparkSession) -> DataFrame:
        """Keys that aren't asked for again."""
        done = self.read(spark)
        return (done.where("status = 'ok'") if self.retry_failed else done).select(*KEY)

    def complete(self, requests: DataFrame) -> DataFrame:
        """requests: request_id, model, prompt, prompt_sha256, each key once.  Their completions, once all are logged."""
        asked = store(requests.select("request_id", *KEY), "asked")
        self.ask(asked, requests)
        return asked.join(self.read(requests.sparkSession).drop("request_id"), KEY).select(*COLUMNS)

    def ask(self, asked: DataFrame, requests: DataFrame) -> None:
        """Logs what is missing.  asked: the requests without their prompts, stored.

        Only keys are compared with the log; prompts are computed where some are missing, and go to their slice's files by
        one shuffle, in as many files as tasks call.
        """
        spark = asked.sparkSession
        path = new_dir(spark, "missing")
        asked.join(self.known(spark), KEY, "left_anti").select(*KEY).write.parquet(path)
        missing = spark.read.schema("model string, prompt_sha256 string").parquet(path)
        n = missing.count()
        if n:
            prompts = requests.select("request_id", *KEY, "prompt")
            if n < asked.count():
                prompts = prompts.join(missing, KEY, "left_semi")
            self._call(prompts, n)
        delete(spark, path)

    def _call(self, prompts: DataFrame, n: int) -> None:
        spark, path = prompts.sparkSession, new_dir(prompts.sparkSession, "pending")
        parallel = self.tasks or spark.sparkContext.defaultParallelism
        part = F.pmod(F.xxhash64(F.lit(1), "prompt_sha256"), F.lit(parallel)).cast("int")
        at_once = max(1, min(SLICES_AT_ONCE, -(-n // self.every)))
        dealt = self.slices(prompts, n).repartitionById(parallel * at_once, F.col("slice") % at_once * parallel + part)
        dealt.write.partitionBy("slice").parquet(path)
        pending = spark.read.schema(f"{','.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, slice int").parquet(path)
        for (number,) in sorted(map(tuple, pending.select("slice").distinct().collect())):  # one row a slice
            called = call_models(pending.where(F.col("slice") == number).coalesce(parallel), self.make, self.threads)
            called.withColumn("run", F.lit(self.run)).write.mode("append").parquet(self.path)
        delete(spark, path)


def usage(calls: DataFrame) -> DataFrame:
    """Per model: calls, failed ones and the tokens that went in and came out."""
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
