"""Substring deduplication against plain Python."""

import hashlib
import random
import re

import pytest

from quizloom.llm import substring


def plain(rows):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(split):
        w = split[i]
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    out = {}
    for i, w in split.items():
        gone = {s + j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, s) for j in range(20)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def agree(spark, rows):
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest_repeats(table).collect()}
    assert got == plain(rows)


def samples():
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = fresh(60), fresh(21)
    rows = [(9, passage), (4, f"{fresh(30)} {passage} {fresh(7)}"), (7, passage.replace(" ", "\n\t")), (1, None), (2, ""), (3, fresh(19))]
    rows += [(20 + i, f"{fresh(3)} {other} {fresh(9)} {passage[: 200 + i]}") for i in range(12)]
    rows += [(50, "v " * 100), (51, "v " * 40), (52, "a b " * 50), (53, other + " " + other), (54, passage.upper()), (55, f"é {passage} é")]
    return rows


def test_small_cases(spark):
    agree(spark, samples())


@pytest.mark.parametrize("heavy", [0, 3])
def test_heavy_anchors_give_the_same(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring, "HEAVY", heavy)
    agree(spark, samples())


def test_real_table(spark, tiny):
    agree(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()])


def test_ties_nulls_and_empty(spark):
    p = " ".join(f"w{i}" for i in range(25))
    table = spark.createDataFrame([(1, p), (1, p), (2, p), (None, p), (3, None)], "doc_id long, text string")
    got = [tuple(r)[:3] for r in substring.remove_repeats(table).collect()]
    assert sorted(got, key=str) == sorted([(1, 25, 0), (1, 25, 0), (2, 25, 25), (None, 25, 25), (3, 0, 0)], key=str)
    assert substring.remove_repeats(table.limit(0)).count() == 0


def test_automaton():
    rng = random.Random(6)
    for _ in range(200):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        query = [rng.randrange(3) for _ in range(12)]
        a = substring.SuffixAutomaton()
        for t in texts:
            a.add(t)
        parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([0] + [n for n in range(1, i + 2) if tuple(query[i + 1 - n : i + 1]) in parts]) for i in range(len(query))]
        assert list(a.matching(query)) == want
