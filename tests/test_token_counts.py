"""Token counts and packing against a plain fold that counts every text anew."""

import random

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quizloom.operators import chunks, token_counts
from quizloom.operators.completions import Completions


def _plain(whole, pieces, count, size, overlap):
    """Chunks of one document: units one after the other, with counts of whole units carried over."""
    if count(whole) <= size:
        return [(0, 0, count(whole), whole)]
    out, held, used, start = [], [], 0, 0
    for unit in pieces:
        if held and used + count(unit) > size:
            out.append((len(out), start, start + used, "\n\n".join(held).strip()))
            start = max(0, start + used - overlap)
            carried, kept = [], 0
            for old in reversed(held):
                if carried and kept + count(old) > overlap:
                    break
                carried.insert(0, old)
                kept += count(old)
                if kept >= overlap:
                    break
            held, used = carried, kept
        held, used = [*held, unit], used + count(unit)
    return [*out, (len(out), start, start + used, "\n\n".join(held).strip())]


def _texts(seed):
    rng = random.Random(seed)
    unit = lambda: " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12)))
    shared = [unit() for _ in range(5)]
    every = ["\n\n".join(rng.choice(shared) if rng.random() < 0.3 else unit() for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    return every + ["", " ", "one", "\n\n\n", "x " * 500, "a line. " * 60, "\n".join(["l1 l1"] * 80)]


@pytest.mark.parametrize("size, overlap", [(20, 5), (20, 0), (7, 7), (1, 3)])
def test_packing_by_words(spark, size, overlap):
    rows = list(enumerate(_texts(size)))
    docs = spark.createDataFrame(rows, "k int, text string")
    pieces = {r["k"]: r["u"] for r in docs.select("k", F.flatten(F.transform(chunks.units(F.col("text")), lambda u: chunks.split_unit(u, size))).alias("u")).collect()}
    got = {}
    for r in chunks.pack(docs, "k", size, overlap).orderBy("chunk_index").collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    assert got == {k: _plain(t, pieces[k], lambda x: len(x.split()), size, overlap) for k, t in rows}
    assert sum(map(len, got.values())) > len(rows)


def test_packing_by_calls_counts_each_text_once(spark, tmp_path):
    """Counts that no sum of words gives; over two runs every distinct text is sent once."""
    sent = tmp_path / "sent"
    tokens = lambda t: len(t) % 11 if len(t) % 3 else 0

    def make():
        def call(text, model):
            with open(sent, "a") as f:
                f.write(repr(text) + "\n")
            return "", tokens(text), 0

        return call

    def count(t):
        return tokens(t) or (max(1, len(t) // 4) if t else 0)

    rows = list(enumerate(_texts(1)))
    docs = spark.createDataFrame(rows, "k int, text string")
    pieces = {r["k"]: r["u"] for r in docs.select("k", F.flatten(F.transform(chunks.units(F.col("text")), lambda u: chunks.split_unit(u, 30))).alias("u")).collect()}
    want = {k: _plain(t, pieces[k], count, 30, 6) for k, t in rows}
    for part in (docs.where("k % 2 = 0"), docs):
        got = {}
        for r in token_counts.pack_counted(part, "k", 30, 6, "m", Completions(make, str(tmp_path / "log"))).orderBy("chunk_index").collect():
            got.setdefault(r["k"], []).append(tuple(r)[1:])
        assert got == {k: v for k, v in want.items() if k in got} and len(got) == part.count()
    lines = sent.read_text().splitlines()
    assert len(lines) == len(set(lines)) == len({t for k, w in rows for t in [*pieces[k], w]})


def test_texts_stay_where_the_log_has_all(spark, tmp_path):
    """Texts are read twice in the first run, for their hashes and for the calls, and once after that; a new one is sent alone."""
    reads, sent = spark.sparkContext.accumulator(0), tmp_path / "sent"
    seen = F.udf(lambda t: (reads.add(1), t)[1], "string").asNondeterministic()
    texts = spark.createDataFrame([(f"t{i % 40}" * 50,) for i in range(80)], "text string")

    def make():
        def call(text, model):
            with open(sent, "a") as f:
                f.write(text[:3] + "\n")
            return "", len(text), 0

        return call

    def run(rows):
        before = reads.value
        got = token_counts.counted(rows.select(seen("text").alias("text")), "m", Completions(make, str(tmp_path / "log"), every=7)).collect()
        assert sorted(r["n"] for r in got) == sorted(len(r["text"]) for r in rows.distinct().collect())
        return reads.value - before

    assert run(texts) == 160 and run(texts) == 80
    assert len(sent.read_text().split()) == 40
    run(texts.unionByName(spark.createDataFrame([("new",)], "text string")))
    assert sent.read_text().split()[40:] == ["new"]


def test_packing_reads_documents_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: (reads.add(1), t)[1], "string").asNondeterministic()
    docs = spark.createDataFrame(list(enumerate(_texts(2)[-7:])), "k int, text string").select("k", seen("text").alias("text"))
    make = lambda: lambda text, model: ("", len(text), 0)
    got = token_counts.pack_counted(docs, "k", 30, 6, "m", Completions(make, str(tmp_path / "log"))).collect()
    assert len({r["k"] for r in got}) == 7 and reads.value == 7


def test_calls_are_dealt_to_all_tasks(spark, tmp_path):
    make = lambda: lambda text, model: ("", TaskContext.get().partitionId() + 1, 0)
    texts = spark.range(200).select(F.col("id").cast("string").alias("text"))
    got = {r["n"] for r in token_counts.counted(texts, "m", Completions(make, str(tmp_path / "log"))).collect()}
    assert len(got) == spark.sparkContext.defaultParallelism
    assert {r["n"] for r in token_counts.counted(texts, "m", Completions(make, str(tmp_path / "one"), tasks=1)).collect()} == {1}


def test_counts_of_odd_texts(spark, tmp_path):
    texts = spark.createDataFrame([("abcdefgh",), ("ab",), ("",), (None,), ("abcdefgh",)], "text string")
    log = Completions(lambda: lambda text, model: "no numbers", str(tmp_path / "log"))
    got = {r["digest"]: r["n"] for r in token_counts.counted(texts, "m", log).collect()}
    told = {r["text"]: got[r["d"]] for r in texts.where("text is not null").select("text", token_counts.digest(F.col("text")).alias("d")).collect()}
    assert told == {"abcdefgh": 2, "ab": 1, "": 0} and len(got) == 3


def test_tokenizer_counts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = spark.createDataFrame([("hello there",), ("Größe",)], "text string")
    got = {r["digest"]: r["n"] for r in token_counts.counted(texts, "m", Completions(token_counts.tokenizer_client(path), str(tmp_path / "log"))).collect()}
    made = Tokenizer.from_file(path)
    told = {r["text"]: got[r["d"]] for r in texts.select("text", token_counts.digest(F.col("text")).alias("d")).collect()}
    assert told == {t: len(made.encode(t).ids) for t in ("hello there", "Größe")}
