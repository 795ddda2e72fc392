"""Nulls, repeated rows, clashing names and very long texts in the operators whose own tests don't have them, and reputation against plain numbers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quizloom.llm import fingerprint, mixing, neardup, url_filter


def _plain_reputation(outcomes):
    """Posterior means and bounds by the formulas, one number at a time."""
    hosts = {}
    for host, bad in outcomes:
        n, b = hosts.get(host, (0.0, 0.0))
        hosts[host] = (n + (bad is not None), b + (bad or 0))
    suffix = lambda h: h.rpartition(".")[2]
    domain = lambda h: ".".join(h.split(".")[-2:])

    def grouped(level, of):
        out = {}
        for k, (n, b) in level.items():
            m = out.get(of(k), (0.0, 0.0))
            out[of(k)] = (m[0] + n, m[1] + b)
        return out

    def shrunk(level, mean):
        spread = weight = 0.0
        for k, (n, b) in level.items():
            if n > 0:
                m = mean(k)
                spread += n * (b / n - m) ** 2 - m * (1 - m)
                weight += (n - 1) * m * (1 - m)
        rho = spread / weight if weight > 0 else None
        s = 1 / rho - 1 if rho is not None and rho > 0 else url_filter.MAX_STRENGTH
        s = min(max(s, url_filter.MIN_STRENGTH), url_filter.MAX_STRENGTH)
        return {k: ((b + mean(k) * s) / (n + s), n + s) for k, (n, b) in level.items()}

    domains = grouped(hosts, domain)
    suffixes = grouped(domains, suffix)
    n, b = (sum(x[i] for x in suffixes.values()) for i in (0, 1))
    top = shrunk(suffixes, lambda k: (b + 1) / (n + 2))
    middle = shrunk(domains, lambda k: top[suffix(k)][0])
    return {h: (p, p - url_filter.Z * (p * (1 - p) / (t + 1)) ** 0.5) for h, (p, t) in shrunk(hosts, lambda k: middle[domain(k)][0]).items()}


def test_reputation_is_that_of_the_formulas(spark):
    rng = random.Random(2)
    outcomes = []
    for d in range(25):
        rate = rng.random()
        for h in range(rng.randrange(1, 5)):
            host = f"h{h}.d{d}.{rng.choice(['com', 'net'])}"
            outcomes += [(host, rng.choice([None, int(rng.random() < rate)])) for _ in range(rng.randrange(1, 40))]
    table = spark.createDataFrame(outcomes, "host string, bad int").repartition(5)
    want = _plain_reputation(outcomes)
    got = {r["host"]: (r["post"], r["bound"]) for r in url_filter.host_reputation(table).collect()}
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(v, rel=1e-9) for h, v in want.items())


def test_urls_repeated_null_and_clashing(spark):
    rows = [(1, "http://a.com/x", "h", 1.0), (1, "http://a.com/x", "h", 1.0), (None, "http://a.com/y", "i", None), (None, None, None, None), (2, "http://" + "b" * 100_000 + ".net/", "j", 2.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, bound double").withColumn("rule", F.lit("r"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    got = url_filter.judge(pages, labels).collect()
    assert sorted((r["page_id"] or 0, r["path"]) for r in got) == [(0, ""), (0, "/y"), (1, "/x"), (1, "/x"), (2, "/")]
    assert {r["verdict"] for r in got if r["page_id"] == 2} == {"block"} and len({r["bad_rate"] for r in got if r["host"] == "a.com"}) == 1


def test_mixing_null_ids_and_repeated_rows(spark):
    rows = [(None, "a", "s"), (None, "a", "s"), (7, "b", "s"), (7, "c", None)] * 50
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    draws = {}
    for r in got.collect():
        key = (r["doc_id"], r["source"], r["text"])
        draws.setdefault(key, []).append(r["copy"])
    for (i, _, _), copies in draws.items():  # all rows of one id and source draw the same number
        assert sorted(copies) == sorted(list(range(max(copies) + 1)) * (100 if i is None else 50))


def test_fingerprints_of_long_texts_and_many_null_ids(spark):
    rows = [(None, f"n{i % 3}") for i in range(40)] + [(5, "é x" * 40_000), (4, "É X" * 40_000), (3, None)]
    got = fingerprint.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows)
    long = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert long[5]["n_chars"] == 120_000 and long[5]["fingerprint"] == long[4]["fingerprint"] and long[5]["near_next"] == 1.0
    text, after = "é x" * 40_000, "É X" * 40_000
    assert long[5]["edited_sha256"] == hashlib.sha256((text[:60_000] + after[:60_000]).encode()).hexdigest()
    assert len({r["fingerprint"] for r in got if r["doc_id"] is None}) == 3


def test_near_duplicates_of_one_id_with_two_texts(spark):
    """Each row's shingles are its own; the id is linked with what either text is like."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    table = spark.createDataFrame([(5, a), (5, b), (3, a + " x"), (9, b + " y"), (7, "c d")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table).collect())
    assert got == [(3, 37, 3), (5, 36, 3), (5, 36, 3), (7, 1, 7), (9, 37, 3)]
