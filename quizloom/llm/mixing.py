"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its share of the budget over its rows.
Each document draws its number of copies by inverting the Poisson distribution at
a uniform number hashed from (seed, doc_id); it is exploded by that count, and the
copies are dealt over all partitions by a hash and sorted by it, which is a global
shuffle that any machine can repeat.

Defined results: a null source is a source of its own; rows with one doc_id draw
the same count; a null doc_id hashes like the empty text; an empty table gives an
empty result; columns of the input are carried along unless they are named copy or
shuffle_key, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 17
#: Rates are broadcast up to this many sources; beyond that they are joined by salted shuffle.
MAX_BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(*parts: Column | str) -> Column:
    """Uniform in [0, 1) from the first 52 bits of an MD5."""
    key = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: dict[str, float] | None, budget: int | None) -> DataFrame:
    """One row per source: _source, rate, cdf (array of P(count <= k)).

    weights: by source, others get none; null: the same for each source.
    """
    counts = docs.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for s, w in weights.items():
            weight = F.when(F.col("_source") == s, F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    whole = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n")).first()
    total_w, total_n = float(whole["all_w"] or 1.0), float(whole["all_n"] or 0)
    rate = F.col("w") * F.lit((total_n if budget is None else float(budget)) / total_w) / F.col("n")
    # The tail beyond this many copies has a probability below 1e-16.
    most = F.ceil(F.lit(20.0) + F.col("rate") + 12 * F.sqrt("rate")).cast("int")
    start = F.struct(F.array().cast("array<double>").alias("cdf"), (-F.col("rate")).alias("log_p"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        total = acc["sum"] + F.exp(acc["log_p"])
        return F.struct(
            F.concat(acc["cdf"], F.array(total)).alias("cdf"),
            (acc["log_p"] + F.ln(F.greatest("rate", F.lit(1e-300))) - F.ln((k + 1).cast("double"))).alias("log_p"),
            total.alias("sum"),
        )

    counts = counts.withColumn("rate", rate)
    return counts.select(
        "_source", "n", "rate", F.aggregate(F.sequence(F.lit(0), most), start, step, lambda a: a["cdf"]).alias("cdf")
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as often as it was drawn, with copy (from 0) and shuffle_key, in a globally shuffled order."""
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    table = rates(docs, weights, budget).select("_source", "cdf").persist()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), "source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if table.count() <= MAX_BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(table), same)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(salted, same & (F.col("salt") == F.col("_salt")))
    # Smallest k with P(count <= k) > u; the array ends where the rest is below rounding.
    u = uniform(str(seed), F.col("id"))
    rows = rows.withColumn("u", u).withColumn("draws", F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
    rows = rows.where("draws > 0").select("row", "id", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)).alias("copy"))
    rows = rows.select("row.*", "copy", uniform(str(seed), F.col("id"), F.col("copy")).alias("shuffle_key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
