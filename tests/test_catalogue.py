"""Every query with SQL against DuckDB on the same tables, and the others against brute force."""

import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quizloom.operators import chunks
from quizloom.plans import catalogue


def _plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


def _sorted(rows):
    return sorted(tuple(repr(_plain(v)) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, tiny, duck, name):
    got = catalogue.QUERIES[name](spark, tiny)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert _sorted(got.select(*columns).collect()) == _sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0


def test_packing_keeps_every_word(spark, tiny):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    packed: dict = {}
    for r in catalogue.pack_units(spark, tiny).orderBy("doc_id", "chunk_index").collect():
        packed.setdefault(r["doc_id"], []).append(r["text"])
    for doc_id, parts in packed.items():
        want, got = docs[doc_id].split(), " ".join(parts).split()
        if len(parts) == 1:
            assert got == want
        else:
            assert len(got) >= len(want) and set(got) == set(want)


def test_tokenizer_windows_overlap_as_told(spark, tiny):
    rows = catalogue.tokenizer_windows(spark, tiny).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_doc.values():
        parts.sort(key=lambda r: r["chunk_index"])
        for a, b in zip(parts, parts[1:]):
            assert b["token_start"] == a["token_start"] + 512 - 96
            assert a["token_end"] - a["token_start"] == 512


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizer_windows_are_those_of_whole_texts(spark, name, monkeypatch):
    """Texts of odd white space, contractions, several scripts and a special token, as offsets of one encoding tell; words that come again are encoded once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng, path = random.Random(3), public_tokenizers.path(name)
    signs = ["a", "B", "é", "ß", "的", "😀", "1", "'s", "'", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", ".", ",", "!", "-", "the ", " of", "e\u0301", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 60))) for _ in range(1500)] + ["the cat. " * 40, "", " ", "\n"]
    made, want = Tokenizer.from_file(path), []
    for k, text in enumerate(texts):
        at = made.encode(text, add_special_tokens=False).offsets
        for i, start in enumerate(range(0, len(at), 5)):
            end = min(len(at), start + 8)
            if piece := text[at[start][0] : at[end - 1][1]].strip():
                want.append((k, i, start, end, piece))
            if end == len(at):
                break
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert sorted(map(tuple, chunks.tokenizer_windows(docs, "k", path, 8, 3).collect())) == want
    seen, whole = [], "the cat. " * 500
    tokens = chunks._Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "encode", lambda t, of=tokens.encode: seen.append(len(t)) or of(t))
    assert len(list(tokens.windows(tokens.pieces([whole])[0], 512, 96))) > 2 and len(tokens.counts) == 5 and max(seen) < 6


def test_window_of_short_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, " ".join("x" * 10))], "k int, text string")
    rows = {(r["k"], r["chunk_index"], r["token_start"], r["token_end"], r["text"]) for r in chunks.windows(docs, "k", 4, 1).collect()}
    assert rows == {
        (1, 0, 0, 3, "a b c"), (4, 0, 0, 4, "x x x x"), (4, 1, 3, 7, "x x x x"), (4, 2, 6, 10, "x x x x"),
    }


def test_markdown_golden_cases(spark):
    cases = {"# \n\nfoo\n# real  \nz": [("Preamble", 0), ("real", 1)], "  # indented\n# ok": [("Preamble", 0), ("ok", 1)], "#nospace": [("Preamble", 0)], "": [("Full Document", 0)]}
    docs = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    got: dict = {}
    for r in chunks.sections(docs, "k").orderBy("k", "ordinal").collect():
        got.setdefault(r["k"], []).append((r["title"], r["level"]))
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_plans_read_only_what_they_need(spark, tiny):
    plan = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id").where(F.col("doc_id") > 5)
    assert "ReadSchema: struct<doc_id:bigint>" in plan._jdf.queryExecution().toString()
    scores = catalogue.score_overall(spark, tiny)._jdf.queryExecution().toString()
    assert "text" not in scores.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert "CartesianProduct" not in scores
