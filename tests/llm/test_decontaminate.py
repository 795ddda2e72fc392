"""Decontamination against plain Python."""

import regex
from pyspark.sql import functions as F

from quizloom.llm import decontaminate


def plain_words(t):
    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def plain_similarity(a, b):
    count = lambda w: {g: n for g in {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for n in [sum(tuple(w[i : i + 5]) == g for i in range(len(w) - 4))]}
    ca, cb = count(a), count(b)
    weigh = lambda g: len(" ".join(g))
    every = set(ca) | set(cb)
    low = sum(weigh(g) * min(ca.get(g, 0), cb.get(g, 0)) for g in every)
    return low / max(1, sum(weigh(g) * max(ca.get(g, 0), cb.get(g, 0)) for g in every))


def plain(docs, items):
    found = {}
    for d, t in docs:
        w = plain_words(t)
        for i, x in items:
            y = plain_words(x)
            if len(y) < 5 or len(w) < 5:
                continue
            grams = {tuple(y[k : k + 5]) for k in range(len(y) - 4)}
            starts = {max(0, min(k - q, len(w) - len(y))) for k in range(len(w) - 4) if tuple(w[k : k + 5]) in grams for q in range(len(y) - 4) if y[q : q + 5] == w[k : k + 5]}
            best = max((plain_similarity(w[s : s + len(y)], y) for s in starts), default=0)
            if best >= 0.75:
                found[d, i] = round(best, 9)
    return found


def told(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.contaminated(d, b).collect()}


def test_real_tables(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain(docs, items)
    assert want and told(spark, docs, items) == want


def test_edges(spark):
    item = " ".join(f"w{i}" for i in range(30))
    items = [(1, item), (2, item + " more"), (3, "too short"), (4, None), (5, ""), (1, item), (7, "a b c d e")]
    far = " ".join(f"z{i}" for i in range(300))
    docs = [
        (1, f"{far} {item} {far}"), (2, item.upper().replace(" ", "\n--")), (3, item.replace("w15", "q")), (4, None), (5, ""), (6, "a b c"),
        (7, "x " * 5000), (8, item[:-4]), (8, far), (8, far), (None, item), (10, "a, b; c. d! e?"), (11, item + " " + item),
    ]
    got = told(spark, docs, items)
    assert {k for k in got if k[0] != 8} == {k for k in plain(docs, items) if k[0] != 8}
    assert (8, 1) in got and (None, 1) in got and (3, 1) not in got
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_id", F.lit(1))
    left = decontaminate.clean(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] == 8) == [(8, far), (8, far)]
    assert {r["doc_id"] for r in left} == {3, 4, 5, 6, 7, 8}
    assert decontaminate.clean(d, spark.createDataFrame([], "item_id long, text string")).count() == len(docs)
    assert decontaminate.contaminated(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    import random

    rng = random.Random(3)
    rows = []
    for n in range(400):
        a = [rng.getrandbits(64) for _ in range(2)]
        b = list(a)
        for bit in rng.sample(range(128), n % 32):
            b[bit // 64] ^= 1 << bit % 64
        signed = lambda x: [v - (1 << 64) if v >> 63 else v for v in x]
        rows.append((signed(a), signed(b), n % 32))
    table = spark.createDataFrame(rows, "a array<long>, b array<long>, d int")
    share = F.size(F.array_intersect(decontaminate._blocks(F.col("a")), decontaminate._near_blocks(F.col("b"))))
    out = table.select("d", decontaminate.distance(F.col("a"), F.col("b")).alias("got"), share.alias("share")).collect()
    assert all(r["d"] == r["got"] and r["share"] >= 1 for r in out)


def test_passages_cut_at_either_edge(spark):
    items, docs = [], []
    for n in (14, 20, 30, 40, 59):
        item = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for k in range(1, n // 5 + 1):
            for side in (0, 1):
                w = item[k:] if side else item[:-k]
                around = [[f"d{n}k{k}s{side}p{p}x{i}" for i in range(100)] for p in (0, 1)]
                docs.append((1000 * n + 10 * k + side, " ".join(around[0] + w + around[1])))
    want = plain(docs, items)
    assert {d // 1000 for d, _ in want} == {14, 20, 30, 40, 59} and min(want.values()) < 0.77
    assert told(spark, docs, items) == want


def test_recall_by_band_and_of_the_radius(spark):
    import random

    rng = random.Random(7)
    items, docs = [], []
    for n in (20, 60, 200, 600):
        item = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for k in range(24):
            w = list(item)
            lost = rng.randrange(1, max(2, n // 8))
            if k % 2:
                w[:lost] = [f"d{n}k{k}x{i}" for i in range(lost)]
            else:
                for i in rng.sample(range(n), max(1, lost // 5)):
                    w[i] = f"d{n}k{k}x{i}"
            around = [[f"d{n}k{k}p{p}x{i}" for i in range(40)] for p in (0, 1)]
            docs.append((1000 * n + k, " ".join(around[0] + w + around[1])))
    want = plain(docs, items)
    bands = [sum(a <= s < b for s in want.values()) for a, b in ((0.75, 0.8), (0.8, 0.9), (0.9, 1))]
    assert all(bands), bands
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == want
    assert sum(r["distance"] <= decontaminate.RADIUS for r in got) >= 0.97 * len(want)
