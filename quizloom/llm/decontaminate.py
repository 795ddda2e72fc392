"""Benchmark decontamination by SimHash windows of an item's size.

A document is contaminated by an item if one of its windows of as many words as
the item has a weighted five-word-shingle similarity of ``SIMILARITY`` or more with
it.  Words are runs of letters and digits, lower-cased.

1. A window can only pass if it shares a shingle with the item, so windows are
   taken where a shingle of the document is one of the benchmark's, aligned on it.
   A Bloom filter of the benchmark's shingles, a literal of the plan whose size is
   bounded by ``bits.MOST``, leaves few positions inside each row; an equi-join on
   the shingle then leaves the real ones.  The starts go back to their documents, so
   each window is cut once.
2. Every window and item gets a 128-bit SimHash of its words.  Of ``BLOCKS`` blocks
   two hashes within ``RADIUS`` differ by one bit at most in one, so an equi-join of
   the windows' blocks with the items' blocks and their neighbours by one bit finds
   all pairs of one length within the radius.
3. The radius leaves out a pair in a few hundred at the limit.  An equi-join of the
   windows' shingles with each item's rarest shingles that weigh more than a quarter
   of it finds all pairs that can reach ``SIMILARITY``, those included.
4. The exact similarity decides.

Texts don't cross the network, unless windows are in more documents than can be
broadcast; the words of windows do.

Defined results: a null or empty text, or one with fewer than five words, isn't
contaminated; items of fewer than five words have no shingle and are not searched;
null item texts likewise; rows with one doc_id are told apart by their text;
repeated rows and empty tables are fine; other columns are passed through by
``clean`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm import bits
from quizloom.llm.scratch import store

WORDS = 5
SIMILARITY = 0.75
BLOCKS, BLOCK_BITS = 16, 8
RADIUS = 2 * BLOCKS - 1
#: Contaminated documents, or windows to be cut, are broadcast up to this many, and joined by shuffle beyond.
MAX_BROADCAST = 500_000


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _shingle(words: Column, i: Column) -> Column:
    """Hash of the shingle that starts at index i, from 0."""
    return F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])


def _shingles(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - WORDS)
    return F.when(F.size(words) >= WORDS, F.transform(starts, lambda i: _shingle(words, i))).otherwise(
        F.array().cast("array<bigint>")
    )


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Distinct items (item_id, words) that have a shingle."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("words"))
    return items.where((F.size("words") >= WORDS) & F.col("item_id").isNotNull()).distinct()


def simhash(words: Column) -> Column:
    """Two longs; bit b is set where more than half of the words have bit b in their hash."""

    def half(seed: int) -> Column:
        hashed = F.transform(words, lambda w: F.xxhash64(F.lit(seed), w))

        def bit(b: Column) -> Column:
            ones = F.aggregate(hashed, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int"))
            return F.when(2 * ones > F.size(words), bits.one(b)).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(bit(b)))

    return F.array(half(1), half(2))


def _blocks(fp: Column) -> Column:
    """Number and value of each block of a SimHash, as one integer."""
    out = []
    for k in range(BLOCKS):
        part = F.shiftrightunsigned(F.get(fp, F.lit(k // 8)), BLOCK_BITS * (k % 8)).bitwiseAND(F.lit(255).cast("bigint"))
        out.append((F.lit(256 * k).cast("bigint") + part).cast("int"))
    return F.array(*out)


def _near_blocks(fp: Column) -> Column:
    """The blocks and all that differ from one by a bit; hashes within RADIUS of fp have a block among them."""
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(BLOCK_BITS)])
    return F.flatten(F.transform(_blocks(fp), lambda x: F.transform(flips, lambda f: x.bitwiseXOR(f))))


def distance(a: Column, b: Column) -> Column:
    return sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(2))


def grams(words: Column) -> Column:
    """The shingles of a word array of WORDS words or more, as texts."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - WORDS + 1), lambda i: F.array_join(F.slice(words, i, WORDS), " "))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle arrays: a shingle weighs its letters, times its occurrences."""

    def times(g: Column, s: Column) -> Column:
        return F.size(F.filter(g, lambda x: x == s))

    def step(acc: Column, s: Column) -> Column:
        x, y, w = times(a, s), times(b, s), F.length(s)
        return F.struct((acc["low"] + w * F.least(x, y)).alias("low"), (acc["high"] + w * F.greatest(x, y)).alias("high"))

    zero = F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))
    return F.aggregate(F.array_union(a, b), zero, step, lambda acc: acc["low"] / acc["high"])


def probes(items: DataFrame) -> DataFrame:
    """item_id, item_hash, h: shingles of each item of which every window alike enough holds one, those in few items first."""
    each = items.select("item_id", F.xxhash64("words").alias("item_hash"), F.explode(grams(F.col("words"))).alias("g"))
    each = each.groupBy("item_id", "item_hash", "g").agg(F.sum(F.length("g")).alias("w"))
    each = each.withColumn("items", F.count(F.lit(1)).over(Window.partitionBy("g")))
    item = Window.partitionBy("item_id", "item_hash")
    before = F.coalesce(F.sum("w").over(item.orderBy("items", "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("before", before).withColumn("whole", F.sum("w").over(item))
    # The shingles from here on weigh less than SIMILARITY of the item.
    return each.where(F.col("before") <= (1 - SIMILARITY) * F.col("whole")).select("item_id", "item_hash", F.xxhash64("g").alias("h"))


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, start, len, window): runs of as many words as an item has, aligned on a shingle of it."""
    places = items.select(F.size("words").alias("len"), F.posexplode(_shingles(F.col("words"))).alias("q", "h")).distinct()
    maybe = bits.table_of(places.select("h").distinct(), "h")
    rows = docs.select("doc_id", "text", normal_words(F.col("text")).alias("words"))
    words = F.col("words")
    found = F.transform(F.col("hashes"), lambda h, i: F.when(maybe(h), i))
    rows = rows.withColumn("hashes", _shingles(words)).withColumn("hits", F.filter(found, lambda i: i.isNotNull()))
    # An outer explode: a filter on the arrays would be pushed down to the scan, and there it would
    # split the text again for every shingle.
    at = F.transform("hits", lambda i: F.struct(i.alias("at"), F.get("hashes", i).alias("h")))
    hits = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words).alias("n"), F.explode_outer(at).alias("e"))
    hits = hits.select("doc_id", "text_hash", "n", "e.*").where(F.col("h").isNotNull())
    start = F.greatest(F.least(F.col("at") - F.col("q"), F.col("n") - F.col("len")), F.lit(0))
    starts = hits.join(places, "h").select("doc_id", "text_hash", F.struct(start.alias("start"), "len").alias("w"))
    starts = store(starts.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("w").alias("_at")), "starts")
    n = starts.agg(F.sum(F.size("_at") + 1)).first()[0] or 0
    starts = F.broadcast(starts) if n <= MAX_BROADCAST else starts
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(starts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    each = texts.select("doc_id", "text_hash", normal_words(F.col("text")).alias("words"), "_at")
    cut = F.transform("_at", lambda w: F.struct(w["start"].alias("start"), w["len"].alias("len"), F.slice(F.col("words"), w["start"] + 1, w["len"]).alias("window")))
    windows = each.select("doc_id", "text_hash", F.explode(cut).alias("w")).select("doc_id", "text_hash", "w.*")
    return windows.where(F.size("window") >= WORDS).dropDuplicates(["doc_id", "text_hash", "start", "len"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document text and item that it holds: doc_id, text_hash, item_id, start (word, from 0), distance, similarity."""
    items = benchmark_items(benchmark).persist()
    windows = _windows(docs, items).select(
        F.struct("doc_id", "text_hash", "start", "len").alias("w"), "len", grams(F.col("window")).alias("mine"), simhash(F.col("window")).alias("fp")
    )
    windows = store(windows, "windows")
    prints = items.select(
        F.struct("item_id", F.xxhash64("words").alias("hash")).alias("item"), F.size("words").alias("len"), grams(F.col("words")).alias("theirs"), simhash(F.col("words")).alias("item_fp")
    ).persist()
    blocks = prints.select("item", "len", "item_fp", F.explode(_near_blocks(F.col("item_fp"))).alias("block"))
    within = windows.select("w", "len", "fp", F.explode(_blocks(F.col("fp"))).alias("block")).join(blocks, ["len", "block"])
    within = within.where(distance(F.col("fp"), F.col("item_fp")) <= RADIUS).select("w", "item")
    rare = probes(items).select(F.struct("item_id", F.col("item_hash").alias("hash")).alias("item"), "h").join(prints.select("item", "len"), "item")
    hashes = F.array_distinct(F.transform("mine", lambda g: F.xxhash64(g)))
    sharing = windows.select("w", "len", F.explode(hashes).alias("h")).join(rare, ["len", "h"]).select("w", "item")
    pairs = within.unionByName(sharing).distinct()
    alike = pairs.join(windows.select("w", "mine", "fp"), "w").join(prints.select("item", "theirs", "item_fp"), "item")
    alike = alike.withColumn("similarity", similarity(F.col("mine"), F.col("theirs"))).where(F.col("similarity") >= SIMILARITY)
    alike = alike.select("w.doc_id", "w.text_hash", "w.start", "item.item_id", "similarity", distance(F.col("fp"), F.col("item_fp")).alias("distance"))
    best = F.max_by(F.struct("start", "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return alike.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select("doc_id", "text_hash", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct().persist()
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")
