"""Token counts of texts, each distinct text counted once over all runs, and chunks packed from them.

What counts is any client that tells how many tokens went in: an endpoint, whose
settings had better ask for one token of output, or a tokenizer on the executors.  The
counts are the calls of a Completions log, so a text that an earlier run counted is
joined by its hash and not sent again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.operators import chunks
from quizloom.operators.completions import Completions
from quizloom.operators.model_calls import Client
from quizloom.sources.scratch import store

#: Characters that count as a token where nothing counted them.
CHARS_PER_TOKEN = 4


def tokenizer_client(path: str) -> Callable[[], Client]:
    """A client that counts with a tokenizer file, which the executors must be able to read."""

    def make() -> Client:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return lambda text, model: ("", len(made.encode(text).ids), 0)

    return make


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def counted(texts: DataFrame, model: str, log: Completions) -> DataFrame:
    """texts: text.  Rows (digest, n) of the distinct texts; where the client told no tokens, a text has a quarter of its characters, one at least."""
    lines = texts.select(F.coalesce("text", F.lit("")).alias("prompt")).withColumn("digest", digest(F.col("prompt")))
    # Texts themselves move only where the log lacks them.
    every = store(lines.select("digest", F.length("prompt").alias("size")).distinct(), "digests")
    named = [F.xxhash64("digest").alias("request_id"), F.lit(model).alias("model"), F.col("digest").alias("prompt_sha256")]
    log.ask(every.select(*named), lines.distinct().select(*named, "prompt"))
    done = log.read(texts.sparkSession).where(F.col("model") == model).select(F.col("prompt_sha256").alias("digest"), "input_tokens")
    guess = F.when(F.col("size") > 0, F.greatest(F.lit(1), F.floor(F.col("size") / CHARS_PER_TOKEN))).otherwise(0)
    told = F.when(F.col("input_tokens") > 0, F.col("input_tokens")).otherwise(guess)
    return store(every.join(done, "digest", "left").select("digest", told.cast("int").alias("n")), "token-counts")


def pack_counted(docs: DataFrame, key: str, size: int, overlap: int, model: str, log: Completions) -> DataFrame:
    """chunks.pack by the counts of a client: the whole texts and their units are counted, and units are packed by their sums.

    docs: key (one row each) and text.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.flatten(F.transform(chunks.units(text), lambda u: chunks.split_unit(u, size)))
    rows = store(docs.select(key, text.alias("text"), pieces.alias("_u")), "pieces")
    each = rows.select(key, F.posexplode(F.array_append("_u", F.col("text"))).alias("at", "text"))
    counts = counted(each.select("text"), model, log)
    found = each.select(key, "at", digest(F.col("text")).alias("digest")).join(counts, "digest")
    listed = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("_n"))  # one number a unit
    return chunks.fold_units(rows.join(listed, key), key, size, overlap)
