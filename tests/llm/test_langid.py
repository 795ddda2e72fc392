"""Language identification: held-out accuracy, Viterbi against plain Python, and edge cases."""

import itertools
import random
import zlib

import numpy as np

from quizloom.llm import langid


def test_held_out_accuracy_on_real_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.predict(docs, langid.fit(docs)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_viterbi(e, switch):
    paths = itertools.product(range(e.shape[1]), repeat=len(e))
    cost = lambda p: sum(e[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    return max(map(cost, paths)), cost


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(0, 7, 4)
        e = rng.normal(size=(sizes.sum(), 3)) * 3
        first = np.concatenate([[0], np.cumsum(sizes)])
        label = langid.viterbi(e, first, 2.0)
        for a, b in zip(first[:-1], first[1:]):
            if b > a:
                best, cost = plain_viterbi(e[a:b], 2.0)
                assert abs(cost(label[a:b].tolist()) - best) < 1e-9


def best_score(e, switch):
    now = e[0].copy()
    for row in e[1:]:
        now = np.maximum(now, now.max() - switch) + row
    return now.max()


def test_viterbi_over_blocks_and_many_languages():
    rng = np.random.default_rng(4)
    for n_labels in (1, 2, 5, 16, 17, 40):
        sizes = np.array([0, 1, 31, 32, 33, 64, 100, 257])
        e = rng.normal(size=(sizes.sum(), n_labels)) * 4
        first = np.concatenate([[0], np.cumsum(sizes)])
        label = langid.viterbi(e, first, 6.0)
        for a, b in zip(first[:-1], first[1:]):
            if b > a:
                path = label[a:b]
                score = e[np.arange(a, b), path].sum() - 6.0 * (path[1:] != path[:-1]).sum()
                assert abs(score - best_score(e[a:b], 6.0)) < 1e-9, (n_labels, b - a)


def test_scripts_by_their_second_byte():
    import pyarrow as pa

    run = next(langid.words.runs(pa.array(["việt ἀρχή ไทย हिन्दी და"]), lower=True, letters=True))
    assert langid._scripts(run).tolist() == [1, 2, 13, 7, 8]


def test_many_languages_share_the_numbers(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_NUMBERS", 40 << 10)
    assert langid.bits_for(40) == 10 and langid.bits_for(10**6) == langid.LEAST_BITS
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(6)
    stock = {f"l{k:02d}": [letters[k % 26] + letters[k // 26] + "".join(rng.choice(letters) for _ in range(4)) for _ in range(20)] for k in range(40)}
    rows = [(i, texts_of(rng, stock[f"l{i % 40:02d}"], 40), f"l{i % 40:02d}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 390


def texts_of(rng, stock, n):
    return " ".join(rng.choice(stock) for _ in range(n))


def test_mixed_text_scripts_and_edges(spark):
    rng = random.Random(1)
    en, de, ru = "the of and with this that have from".split(), "der die und nicht mit schön über auch".split(), "это как все она так его только".split()
    rows = [(i, texts_of(rng, (en, de, ru)[i % 3], 30), ("en", "de", "ru")[i % 3]) for i in range(120)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = texts_of(rng, en, 20) + " " + texts_of(rng, de, 30) + "; " + texts_of(rng, ru, 5)
    odd = [(1, mixed), (2, None), (3, ""), (4, "123 — !? 😀"), (5, "это"), (None, "the and with"), (7, "und " * 20_000), (7, "ÜBER SCHÖN"), (8, "日本")]
    docs = spark.createDataFrame([(i, t, "xx", 1) for i, t in odd], "doc_id long, text string, lang string, score int")
    got = langid.predict(docs, model).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] not in (7, 8)] == ["de", "und", "und", "und", "ru", "en"]
    assert [r["lang_pred"] for r in got if r["doc_id"] == 7] == ["de", "de"]
    spans = [tuple(r)[1:] for r in langid.spans(docs, model).collect() if r["doc_id"] == 1]
    assert spans == [("en", 0, 20), ("de", 20, 30), ("ru", 50, 5)]
    assert langid.predict(docs.limit(0), model).count() == 0
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
