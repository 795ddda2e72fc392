"""Hard negatives against a plain search in Python's integers."""

from math import floor, inf, nan

import numpy as np
import pytest

from quizloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def _plain(rows, every=50):
    """rows: (id, vector, label), all of which take part."""
    rows = [(i, [floor(256 * c) for c in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for i, a, label in rows:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, q, strict=True)), j, other == label) for j, q, other in rows if j != i)
        for ps, pid, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(i, pid, rank, nid, -ps, -ns) for rank, (ns, nid, _) in enumerate(fits, 1)]
    return sorted(out)


def _got(df, every=50):
    return sorted(map(tuple, negatives.hard_negatives(df, every).collect()))


def _rows(n, seed, scale=1.0, width=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width)) + 0.7
    return [(i, (scale * (centres[i * 7 % labels] + rng.normal(size=width) * 0.6)).tolist(), int(i * 7 % labels)) for i in range(n)]


@pytest.mark.parametrize("scale", [0.05, 1.0, 3e3, 2e9])
def test_same_as_plain_search(spark, scale):
    """Scores in floats, in doubles and, at the largest scale, in integers of any size."""
    rows = _rows(300, 3, scale)
    want = [r for r in _plain(rows, 10) if abs(r[4]) < 1 << 63]
    got = [r for r in _got(spark.createDataFrame(rows, SCHEMA).repartition(3), 10) if abs(r[4]) < (1 << 63) - 1]
    assert got == want and (want or scale > 1e9)


def test_chunks_and_blocks_make_no_difference(spark, monkeypatch):
    rows = _rows(400, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(negatives, "CHUNK", 7)
    monkeypatch.setattr(negatives, "PAIRS", 64)
    monkeypatch.setattr(negatives, "FIRST", 3)
    assert _got(df, 10) == _plain(rows, 10) != []


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(1, 60)] + [(i, [0.75, 0.5], 2) for i in range(100, 140)]
    got = _got(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == _plain(rows)
    assert [r[3] for r in got if r[:2] == (50, 1)] == [100, 101, 102]


def test_what_takes_no_part_and_repeated_rows(spark):
    good = _rows(60, 6)
    odd = [(50, None, 1), (100, [1.0] * 6, None), (None, [1.0] * 6, 1), (150, [nan] * 6, 1), (200, [inf] + [0.0] * 5, 1), (250, [], 1), (300, [1.0], 1)]
    odd += [(350, [None] * 6, 1)]
    schema = "vec_id long, embedding array<double>, label int, anchor int, score string"
    df = spark.createDataFrame([(*r, 1, "x") for r in good + odd], schema)
    assert _got(df, 10) == _plain(good, 10)
    twice = good + good[7:9]
    assert _got(spark.createDataFrame(twice, SCHEMA), 10) == _plain(twice, 10)


def test_nothing_to_find(spark):
    assert _got(spark.createDataFrame([], SCHEMA)) == []
    assert _got(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []
    assert _got(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == []
    assert _got(spark.createDataFrame([(50, [1.0], 1), (51, [-1.0], 1), (52, [-0.5], 2)], SCHEMA)) == []


def test_pairs_within_ranges_of_any_width():
    rng = np.random.default_rng(8)
    for low_bits in (2, 9, 20, 40):
        q, anchors = rng.integers(-(2**low_bits), 2**low_bits, (50, 5)), rng.integers(-(2**low_bits), 2**low_bits, (7, 5))
        exact = q.astype(object) @ anchors.astype(object).T
        for share in (0.0, 0.4, 0.95):
            low = np.array([sorted(exact[:, k])[int(49 * share)] for k in range(7)], object)
            high = np.array([max(exact[:, k]) - k for k in range(7)], object)
            row, which, score = negatives.surviving_pairs(q, anchors, low, high)
            want = {(r, k, exact[r, k]) for r in range(50) for k in range(7) if low[k] <= exact[r, k] <= high[k]}
            assert set(zip(row.tolist(), which.tolist(), map(int, score), strict=True)) == want
