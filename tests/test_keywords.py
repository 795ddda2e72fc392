"""Keyword tables against a plain search, and table functions against the columns of the same name."""

import random

import pytest
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.functions import values as V
from quizloom.operators import chunks, keywords, table_functions


def _plain(text, table, default):
    held = [(p, k.lower(), v) for k, v, p in table if k is not None and text is not None and k.lower() in text.lower()]
    return min(held)[2] if held else default


@pytest.mark.parametrize("cut", [1 << 18, 700])
def test_ten_thousand_keywords(spark, monkeypatch, cut):
    """In one automaton and in cuts of it, with priorities that repeat and keywords inside others."""
    monkeypatch.setattr(keywords, "CUT", cut)
    rng = random.Random(cut)
    word = lambda a, b: "".join(rng.choice("abcdeÄß ") for _ in range(rng.randrange(a, b)))
    table = [(word(4, 9), f"v{i}", rng.randrange(3000)) for i in range(10_000)] + [(None, "none", 0)]
    texts = [word(0, 60) for _ in range(300)] + ["", None, "ABCDE" * 2000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    listed = spark.createDataFrame(table, "keyword string, value string, priority int")
    got = {r["i"]: r["hit"] for r in keywords.first_keyword(rows, "text", listed, "hit", "-").collect()}
    want = {}
    for i, t in enumerate(texts):
        held = [(p, k.lower()) for k, v, p in table if k is not None and t is not None and k.lower() in t.lower()]
        want[i] = {v for k, v, p in table if k is not None and held and (p, k.lower()) == min(held)} or {"-"}
    assert set(got) == set(want) and all(got[i] in want[i] for i in want)
    assert sum(v != "-" for v in got.values()) > 100


def test_the_table_gives_what_the_chain_of_cases_gives(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", F.concat("text", F.lit(" Root CANAL"), F.when(F.col("doc_id") % 2 == 0, " of an implant").otherwise("")).alias("text"))
    both = keywords.first_keyword(docs, "text", keywords.keyword_table(spark, V.DISCIPLINE_KEYWORDS), "n", "0").withColumn("m", T.discipline_number(F.col("text")).cast("string"))
    assert both.where(~F.col("n").eqNullSafe(F.col("m"))).isEmpty() and both.select("n").distinct().count() > 1


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "i int, text string")
    run = lambda t: {r["i"]: r["v"] for r in keywords.first_keyword(rows, "text", spark.createDataFrame(t, "keyword string, value string, priority int"), "v").collect()}
    assert run([]) == {1: None, 2: None, 3: None}
    assert run([("", "every", 5), ("b", "b", 1)]) == {1: "b", 2: "every", 3: None}
    assert keywords.first_keyword(rows.limit(0), "text", keywords.keyword_table(spark, [("x", ["a"])]), "v").collect() == []
    with pytest.raises(ValueError):
        run([("x" * 1001, "v", 1)])


def _odd_texts():
    return ["", None, " ", "one", "a b\tc\nd e f g", "\n".join(f"w{i}" for i in range(50)), "# \n\nfoo\n# real  \nz\r\n## two ### three\n#nospace\n  # indented", "# only", "x\x1cy　z"]


def test_table_functions_equal_the_columns(spark):
    table_functions.register(spark)
    docs = spark.createDataFrame(list(enumerate(_odd_texts())), "k int, text string")
    docs.createOrReplaceTempView("_odd")
    for size, overlap in ((3, 1), (4, 0), (1, 5), (100, 10)):
        got = spark.sql(f"select k, c.* from _odd, lateral word_chunks(text, {size}, {overlap}) c")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.windows(docs, "k", size, overlap).collect()))
    got = spark.sql("select k, c.* from _odd, lateral markdown_sections(text) c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.sections(docs, "k").collect()))


def test_tokenizer_chunks(spark):
    import public_tokenizers

    table_functions.register(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "Some text, with ünïcode and more of it. " * 20), (2, "")], "k int, text string")
    docs.createOrReplaceTempView("_tokens")
    got = spark.sql(f"select k, c.* from _tokens, lateral tokenizer_chunks(text, '{path}', 16, 4) c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.tokenizer_windows(docs, "k", path, 16, 4).collect()))
