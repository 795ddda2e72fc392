"""Operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quizloom.operators import build, questions, tasks


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_deal_is_exact(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for n in (0, 1, 10_000, 300_000):
            rows = tasks.deal(spark.range(n).select((F.col("id") * 3).alias("id")), "id", 7)
            assert rows.count() == n and rows.where(F.col("worker") != F.col("id") / 3 % 7).isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_names_holding_sources(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab_.") for _ in range(n))
    files = sorted({text(rng.randrange(1, 30)) for _ in range(300)})
    sources = {text(rng.randrange(1, 12)) for _ in range(200)} | {f[2:14] for f in files if len(f) > 14} | {f for f in files[:20]}
    want = {s: min(f for f in files if s in f) for s in sources if any(s in f for f in files)}
    table = lambda x, name: spark.createDataFrame([(v,) for v in x], f"{name} string")
    got = {r["source"]: r["file"] for r in build.names_holding(table(sources, "source"), table(files, "file")).collect()}
    assert got == want and any(len(s) >= build.PIECE for s in want) and any(len(s) < build.PIECE for s in want)


def test_sidecars_match_by_seed_or_substring(spark):
    cases = spark.createDataFrame([(1, "q", None), (2, "x", " part_of.na "), (3, "x", "  "), (4, "q", "zz"), (5, None, "missing")], "id int, seed string, source string")
    sidecars = spark.createDataFrame([("b_part_of.name", "q"), ("c_zz", "other"), ("azz", "other"), ("d", None)], "file string, seed string")
    got = {r["id"]: r["file"] for r in build.match_sidecars(cases, sidecars).collect()}
    assert got == {1: "b_part_of.name", 2: "b_part_of.name", 3: None, 4: "azz", 5: None}


def test_refine_calls_each_round_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(x: int) -> int:
        calls.add(1)
        return x + 1

    one = F.udf(count, "int")
    start = spark.createDataFrame([(i, 0) for i in range(4)] + [(9, None)], "need int, have int")
    out = questions.refine(start, F.col("have") >= F.col("need"), lambda rows, i: rows.withColumn("have", one(F.coalesce("have", F.lit(0)))))
    got = {r["need"]: (r["have"], r["attempts"]) for r in out.collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (2, 2), 3: (3, 3), 9: (3, 3)}
    out.count()
    assert calls.value == 4 + 3 + 2
