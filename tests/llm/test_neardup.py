"""Near-duplicates against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from quizloom.llm import components as cc
from quizloom.llm import neardup


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def agree(spark, rows, extra=""):
    table = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table).collect()}
    assert got == plain_components(rows)


def test_small_cases(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [
        (9, base), (3, base.upper()), (5, base + " x"), (12, "y " + base + " z"), (20, None), (21, ""), (22, " \n"), (23, "a b"),
        (24, "A  B"), (25, "a b c"), (26, "v " * 30_000), (27, "v v v v v v"), (28, base.replace("w20", "q")),
    ]
    agree(spark, rows)


def test_real_table(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    agree(spark, rows)


def test_large_groups_are_cut_deeper(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 4)
    rng = random.Random(1)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(40):
            w = list(base)
            w[rng.randrange(120)] = f"e{k}"
            rows.append((g * 1000 + k, " ".join(w)))
    rows += [(5000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(30))) for i in range(50)]
    agree(spark, rows)


def test_empty_table_and_null_ids(spark):
    table = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = [tuple(r) for r in neardup.near_duplicates(table).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True)], key=str)
    assert neardup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [0, cc.ONE_TASK])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(cc, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(500, i) for i in range(501, 540)]
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert cc.components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def test_copies_that_are_only_alike_to_the_original(spark):
    rng = random.Random(4)
    rows = []
    for size in (50, 300, 1000):
        base = [f"s{size}w{i}" for i in range(150)]
        rows.append((10_000 * size, " ".join(base)))
        for k in range(1, size + 1):
            w = list(base)
            for n in range(4):
                w[rng.randrange(4 + 36 * n, 36 + 36 * n)] = f"e{size}n{k}n{n}"
            rows.append((10_000 * size + k, " ".join(w)))
    sets = plain_sets(rows)
    assert all(0.75 <= len(s & sets[i - i % 10_000]) / len(s | sets[i - i % 10_000]) <= 0.8 for i, s in sets.items() if i % 10_000)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table).collect()}
    assert got == {i: i - i % 10_000 for i in sets}


def test_the_forced_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    token = np.sort(rng.choice(400, 30, replace=False).astype(np.uint64))
    count = rng.integers(3, 9, 30)
    for _ in range(500):
        a = rng.choice(400, rng.integers(1, 60), replace=False).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.integers(0, len(a) // 4 + 1) :], rng.choice(400, rng.integers(0, 8)).astype(np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            assert len(np.intersect1d(neardup.forced(a, token, count), neardup.forced(b, token, count)))


def test_large_regions_keep_all_neighbours(spark, monkeypatch):
    rng = random.Random(6)
    tree = 4 * neardup.DEPTH
    rows = [(i, b"".join(bytes([t, i % 3] * 4) + rng.randbytes(tree - 8) for t in range(neardup.TREES))) for i in range(200)]
    classes = spark.createDataFrame(rows, "id long, signature binary")
    found = []
    for region in (10**9, 4):
        monkeypatch.setattr(neardup, "REGION", region)
        found.append({(r["u"], r["v"]) for r in neardup.candidates(classes).collect()})
    assert len(found[0]) > 1000 and found[0] <= found[1]


def _crowd(n, own, template=100, copies=0, seed=9):
    """Documents that share a template and are not alike, with own(k) words of their own each; the last ones are copies of the first."""
    rng = random.Random(seed)
    base = " ".join(f"t{i}" for i in range(template))
    rows = [(k, base + " " + " ".join(f"o{k}x{i}" for i in range(own(k)))) for k in range(n)]
    for c in range(copies):
        w = rows[0][1].split()
        w[template + rng.randrange(own(0))] = f"c{c}"
        rows.append((n + c, " ".join(w)))
    return rows


@pytest.mark.parametrize("own, copies", [(lambda k: 18, 0), (lambda k: 14 + k % 30, 0), (lambda k: 18, 150)])
def test_crowds_around_a_template_meet_in_few_rows(spark, monkeypatch, own, copies):
    """Linear join rows where a template is shared by all, where sizes differ, and where one component is large."""
    met, plain = [], neardup._with_all
    monkeypatch.setattr(neardup, "_with_all", lambda rows: met.append(plain(rows).count()) or plain(rows))
    monkeypatch.setattr(neardup, "HOT", 100)
    rows = _crowd(400, own, copies=copies)
    agree(spark, rows)
    assert sum(met) <= 40 * len(rows)


def test_the_shown_shingles_of_the_smaller_set_meet():
    """Of two sets that are alike, one of the few that the smaller one shows is among the forced ones of the larger."""
    rng = np.random.default_rng(15)
    token, count, tried = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for _ in range(3000):
        a = np.unique(rng.choice(400, rng.integers(1, 60), replace=False).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, len(a) // 4 + 1) :], rng.choice(400, rng.integers(0, 8)).astype(np.uint64)]))
        small, large = sorted((a, b), key=len)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            shown = len(small) - -(-150 * len(small) // 175) + 1
            assert len(np.intersect1d(neardup.forced(small, token, count)[:shown], neardup.forced(large, token, count)))
            tried += 1
    assert tried > 500
