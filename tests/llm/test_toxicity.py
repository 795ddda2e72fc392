"""Toxicity: held-out accuracy, its parts against plain Python, and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quizloom.llm import toxicity


def made(n=900):
    rng = random.Random(8)
    stock = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(stock) for _ in range(rng.randrange(20, 80))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "grumbletor", "grumbleta", "scum"]))
        rows.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, 1 if bad else 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    table = spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, table)).collect()}
    truth = dict(labels)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i, r in got.items() if r["held_out"]]
    right = sum(got[i]["predicted"] == truth[i] for i in held)
    assert right / len(held) > 0.95


def test_edges(spark):
    rows, labels = made(300)
    rows += [(None, "x"), (1000, None), (1001, ""), (1002, "word " * 30_000), (1, "other text"), (1003, "...!!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, table)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] is None)["held_out"]
    for few in (table.limit(0), table.where("toxic = 0"), table.where("toxic = 1")):
        assert toxicity.score(docs, toxicity.fit(docs, few)).count() == len(rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), table)).count() == 0
    assert toxicity.clean(docs, table.limit(0)).count() == len(rows)


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 30, 200).astype(float), rng.integers(0, 2, 200).astype(float)
    knots, rates = toxicity.isotonic(x, y)
    fit = np.interp(np.unique(x), knots, rates)
    assert (np.diff(fit) >= -1e-12).all()
    groups = [y[x == v] for v in np.unique(x)]
    n, m = np.array([len(g) for g in groups]), np.array([g.mean() for g in groups])
    best = [max(min(np.average(m[a : b + 1], weights=n[a : b + 1]) for b in range(i, len(m))) for a in range(i + 1)) for i in range(len(m))]
    assert fit == pytest.approx(best)


def test_features_have_the_named_parts():
    empty = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), [], [], 0.0, np.zeros(0), np.zeros(0))
    x = toxicity.features(pa.array(["You IDIOT!", "a calm day", None, "id1ot s-um"]), empty)
    assert x.shape == (4, 15) and x[0, 0] == 0.5 and x[0, 9] == 0.5 and x[1, 0] == 0 and not x[2].any()
    assert x[0, 11] == 0.6 and x[0, 13] == 0.1 and x[3, 14] == 0.2


def test_rates_are_those_of_the_corpus_where_the_sample_is_capped(spark, monkeypatch):
    rng = random.Random(9)
    stock = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    # One text in ten is toxic, and texts tell nothing about it, so each has the rate of one in ten.
    rows = [(i, " ".join(rng.choices(stock, k=30))) for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 300, 0: 300})
    got = [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()]
    assert 0.05 < sum(got) / len(got) < 0.2


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(5)
    x, y, n = rng.integers(0, 30, 200).astype(float), rng.integers(0, 2, 200).astype(float), rng.integers(1, 5, 200)
    for got, want in zip(toxicity.isotonic(x, y, n.astype(float)), toxicity.isotonic(np.repeat(x, n), np.repeat(y, n)), strict=True):
        assert np.allclose(got, want)
