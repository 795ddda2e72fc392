"""MinHash near-duplicates by an LSH forest.

1. Every document becomes a set of word shingles, a 128-bit digest of the set and
   ``TREES`` signatures of ``DEPTH`` min-hashes.
2. Equal sets are one class, stood for by its smallest doc_id.
3. The forest is ``TREES`` sorted orders of the classes, one by each signature.
   Neighbours in an order that agree on a prefix of at least ``MIN_DEPTH`` are
   candidates.  An order is cut into regions by prefix; those that hold more than
   ``REGION`` classes are sorted by ranges over many tasks, and the classes at the
   edges of two ranges meet too, so every class has its neighbours at any size.
4. Candidates are confirmed on the full sets.  Some orders go first; the rest only
   confirm candidates that are not connected yet.
5. Confirmed links give components.
6. What the forest missed is found exactly.  Two sets of similarity 0.75 share one of
   the first quarter of their shingles, whatever the order of all shingles is, and
   the order here puts frequent ones last.  Classes of different components that
   share such shingles, and whose sizes, places and number of shared ones allow 0.75,
   are confirmed on the full sets.  The smaller set of two needs even fewer shingles, one
   in seven, so a template that many share without being alike is shown by none of them.  First each meets the lowest or highest component at its shingles,
   which is one pair a row and joins most groups; then all that are still apart meet.
   Of the pairs those with the partner that most others meet, and with the one that
   shares most, go first, which joins a star to its centre.

The forest only saves work in step 6: a pair at similarity s shares a prefix of two
in one of t trees with probability 1 - (1 - s^2)^t, but it is a candidate only as a
neighbour.  The components are those of all pairs.

Defined results: a null or empty text, or one without words, has no shingles and
is linked with nothing; rows with one doc_id are one document; a null doc_id is
linked with nothing, its component_id is null and it is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm import bits, words
from quizloom.llm.components import components, extended
from quizloom.llm.scratch import small_batches, store

WORDS = 5
TREES, DEPTH, MIN_DEPTH = 16, 8, 2
REGION = 1000
NEIGHBOURS = 2
#: Trees whose candidates are confirmed first.
FIRST_TREES = 2
#: The shingles of one in so many documents tell which are frequent, and so many at most are told.  They only set an order, so they never change a result.
ORDER_SAMPLE, MOST_FREQUENT = 8, 1 << 20
#: Rows of one shingle that a task of the exact join takes from one side; up to FEW meet without more ado.
HOT, FEW = 1000, 32
#: At other shingles they meet by size, in steps of this factor.
SIZE_STEP = 1.05
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75

_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For sets that aren't empty: TREES * DEPTH min-hashes each, 32 bits, big-endian so that bytes sort like numbers."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), TREES * DEPTH), ">u4")
    for j in range(TREES * DEPTH):
        out[:, j] = np.minimum.reduceat(flat * _MULTIPLY[j] + _ADD[j], at) >> np.uint64(32)
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    i = np.arange(1, len(s) + 1, dtype=np.uint64)
    a = words.mix(np.add.reduce(words.mix(s + i * np.uint64(0x9E3779B97F4A7C15)), keepdims=True))
    b = words.mix(np.add.reduce(words.mix(s ^ (i * np.uint64(0xC2B2AE3D27D4EB4F))), keepdims=True))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for run in words.runs(batch.column("text"), lower=True):
            sets = words.shingle_sets(run, WORDS)
            full = [i for i, s in enumerate(sets) if len(s)]
            signed: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    signed[i] = row.tobytes()
            hi, lo = zip(*map(_digest, sets), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(run.lo, run.hi - run.lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(hi, pa.int64()),
                    pa.array(lo, pa.int64()),
                    pa.array(signed, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_hi", "set_lo", "signature"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = (batch.column(k).to_numpy() for k in "uv")
        keep = np.zeros(len(u), bool)
        for i in range(len(u)):
            a = np.frombuffer(batch.column("su")[i].as_buffer(), np.uint64)
            b = np.frombuffer(batch.column("sv")[i].as_buffer(), np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = 100 * common >= PERCENT * (len(a) + len(b) - common)
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The MOST_FREQUENT shingles at most that are in most documents of a sample, sorted, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.runs(batch.column("text"), lower=True):
                every = np.concatenate(words.shingle_sets(some, WORDS))
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], names=["token"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit(21), "doc_id"), F.lit(ORDER_SAMPLE)) == 0).select("text").mapInArrow(run, "token long")
    counts = store(sample.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "frequent")
    at_least = [F.coalesce(F.sum((F.col("n") >= 2**k).cast("long")), F.lit(0)).alias(f"k{k}") for k in range(1, 50)]
    whole = counts.agg(*at_least).first()
    least = 2 ** next(k for k in range(1, 50) if whole[f"k{k}"] <= MOST_FREQUENT)
    listed = counts.where(F.col("n") >= least).toArrow()
    token, count = (listed.column(k).to_numpy() for k in ("token", "n"))
    token = token.astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], count[order].astype(np.int64)


def forced(s: np.ndarray, token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingles of a set, rare ones first, of which each set with PERCENT similarity to it holds one or more of its own."""
    times = np.zeros(len(s), np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        times = np.where(token[at] == s, count[at], 0)
    return s[np.lexsort((s, times))][: len(s) - -(-PERCENT * len(s) // 100) + 1]


def _forced_rows(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows (id, n, tokens): the forced shingles of each document, in their order, and the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.runs(batch.column("text"), lower=True):
                sets = words.shingle_sets(some, WORDS)
                lists = [forced(s, *shared.value).view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, lists)])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int64()))
                ids = batch.column("id").slice(some.lo, some.hi - some.lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), tokens], names=["id", "n", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("id").isNotNull())
    return texts.mapInArrow(run, "id long, n int, tokens array<long>")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (id, c, n, at, shown, token) whose shingle is in several components c, and shown by one row at least, with times: how many rows have it."""
    same = Window.partitionBy("token")
    rows = rows.select(
        "*", F.min("c").over(same).alias("low"), F.max("c").over(same).alias("high"), F.count(F.lit(1)).over(same).alias("times"),
        F.max(F.col("at") < F.col("shown")).over(same).alias("any"),
    )
    return store(rows.where("low != high and any").drop("low", "high", "any"), "mixed")


def missed(docs: DataFrame, classes: DataFrame, joined: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows (id, c, n, at, token, times) by which the classes of different components meet that may be alike enough."""
    of = classes.select("id").join(joined.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    rows = _forced_rows(docs, shared).join(of.select("id", F.coalesce("component", "id").alias("c")), "id")
    return _mixed(rows.select("id", "c", "n", F.expr(_SHOWN).alias("shown"), F.posexplode("tokens").alias("at", "token")))


def _still_mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The same rows with the components as they are now."""
    now = joined.select(F.col("node").alias("id"), "component").hint("merge")
    rows = rows.drop("times").join(now, "id", "left").withColumn("c", F.coalesce("component", "c")).drop("component")
    return _mixed(rows)


_SIDE = ("id", "c", "n", "at")


def _met(both: DataFrame) -> DataFrame:
    """Pairs (u, v, common, nu, nv) of rows that meet at a shingle (id, c, n and at of u and v), if their sizes allow PERCENT."""
    sizes = PERCENT * F.greatest("nu", "nv") <= 100 * F.least("nu", "nv")
    pairs = both.where(sizes).groupBy(F.col("idu").alias("u"), F.col("idv").alias("v"))
    return pairs.agg(F.count(F.lit(1)).alias("common"), F.first("nu").alias("nu"), F.first("nv").alias("nv"))


def _with_outermost(rows: DataFrame) -> DataFrame:
    """Each row with the one of the lowest other component at its shingle, or of the highest: a pair for each row."""
    same, row = Window.partitionBy("token"), F.struct("c", "id", "n", "at")
    rows = rows.withColumn("low", F.min(row).over(same)).withColumn("high", F.max(row).over(same))
    rows = rows.withColumn("o", F.when(F.col("c") == F.col("low.c"), F.col("high")).otherwise(F.col("low")))
    # The smaller id is u, so that the shingles of a pair are counted together.
    ordered = F.col("id") < F.col("o.id")
    sides = [F.when(ordered, F.col(k)).otherwise(F.col(f"o.{k}")).alias(f"{k}u") for k in _SIDE]
    sides += [F.when(ordered, F.col(f"o.{k}")).otherwise(F.col(k)).alias(f"{k}v") for k in _SIDE]
    # Both rows of a pair may name each other at one shingle, which counts once.
    return rows.select(*sides, "token").distinct()


#: SQL: how many of its first shingles a set of n must show to equal or larger sets; one of these is in each that is like it.
_SHOWN = f"cast(n - ({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT} + 1 as int)"


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")


def _with_all(rows: DataFrame) -> DataFrame:
    """Pairs of rows of different components at a shingle that may be alike enough.

    Of two sets the smaller one (by size, then id) shows only the few shingles that equal or larger partners
    need, and the other one all its forced ones.  At a shingle with many rows they meet by size too, within the largest
    size that the smaller one's place there allows, and the largest component there meets the others, not itself.
    """
    small, large = "nu, idu", "nv, idv"
    left = [F.col(k).alias(f"{k}u") for k in _SIDE]
    right = [F.col(k).alias(f"{k}v") for k in _SIDE]
    shown = F.col("at") < F.col("shown")
    few, many = rows.where(F.col("times") <= FEW), rows.where(F.col("times") > FEW)
    both = few.where(shown).select("token", *left).join(few.select("token", *right), "token").drop("token")
    sizes = many.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    top = sizes.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("top"))
    salts = F.ceil(F.col("times") / HOT).cast("int")
    crowd = store(many.join(top, "token").select("*", (F.col("c") == F.col("top")).alias("largest"), salts.alias("salts")), "crowded")
    # (100 + PERCENT) * (n - at) >= PERCENT * (n + the other's size)
    most = F.floor((100 + PERCENT) * (F.col("n") - F.col("at")) / PERCENT).cast("int") - F.col("n")
    reach = F.sequence(_bucket(F.col("n")), _bucket(F.least(most, F.floor(100 * F.col("n") / PERCENT).cast("int"))))
    one = crowd.where(shown & (most >= F.col("n"))).withColumn("size", F.explode(reach))
    one = one.withColumn("of", F.explode(F.when(F.col("largest"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))))
    one = one.select("token", "size", "of", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), *left)
    other = crowd.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    other = other.select("token", _bucket(F.col("n")).alias("size"), F.col("largest").alias("of"), "salt", *right)
    keys = ["token", "size", "of", "salt"]
    both = both.unionByName(one.join(other, keys).drop(*keys))
    # At the first shingle that both hold, no more than the smaller rest can be common.
    rest = F.least(F.col("nu") - F.col("atu"), F.col("nv") - F.col("atv"))
    enough = (100 + PERCENT) * rest >= PERCENT * (F.col("nu") + F.col("nv"))
    both = both.where(F.expr(f"({small}) < ({large})") & (F.col("cu") != F.col("cv")) & (PERCENT * F.col("nv") <= 100 * F.col("nu")) & enough)
    # The smaller id is u, so that the shingles of a pair are counted together.
    ordered = F.col("idu") < F.col("idv")
    swapped = [F.when(ordered, F.col(f"{k}{a}")).otherwise(F.col(f"{k}{b}")).alias(f"{k}{a}") for a, b in ("uv", "vu") for k in _SIDE]
    return both.select(*swapped)


def _hubs(pairs: DataFrame) -> DataFrame:
    """For each class the pair with the partner that most others meet, and the one that has most in common with it."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "common"))
    weight = both.groupBy("u").agg(F.sum("common").alias("w")).select(F.col("u").alias("v"), "w")
    best = both.join(weight, "v").groupBy("u").agg(
        F.max_by("v", F.struct("w", "v")).alias("hub"), F.max_by("v", F.struct("common", "w", "v")).alias("nearest")
    )
    chosen = best.select("u", F.explode(F.array("hub", "nearest")).alias("v"))
    return chosen.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def signed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hi, set_lo, signature (null without shingles)."""
    schema = "doc_id long, n_shingles long, set_hi long, set_lo long, signature binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, schema)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (tree, key, id, region): each row with those before it in its region, and the rows at both edges alone."""
    names = ["tree", "id", "other", "key", "region"]

    def told(rows: pa.Table | pa.RecordBatch, others=None) -> pa.RecordBatch:
        n, edge = rows.num_rows, others is None
        columns = [rows.column("tree"), rows.column("id"), pa.nulls(n, pa.int64()) if edge else pa.array(others, pa.int64())]
        columns += [rows.column("key").cast(pa.binary()) if edge else pa.nulls(n, pa.binary()), rows.column("region")]
        return pa.RecordBatch.from_arrays(columns, names=names)

    tail, seen = None, 0
    for batch in batches:
        if seen < NEIGHBOURS:
            yield told(batch.slice(0, NEIGHBOURS - seen))
        old = 0 if tail is None else tail.num_rows
        rows = batch if tail is None else pa.concat_batches([tail, batch])
        ids, region = (rows.column(k).to_numpy() for k in ("id", "region"))
        for k in range(1, NEIGHBOURS + 1):
            at = np.arange(max(old, k), len(ids))
            at = at[region[at] == region[at - k]]
            yield told(rows.take(pa.array(at)), ids[at - k])
        seen += batch.num_rows
        tail = rows.slice(max(0, rows.num_rows - NEIGHBOURS))
    if seen > NEIGHBOURS:
        yield told(tail.slice(max(0, tail.num_rows - (seen - NEIGHBOURS))))


def _in_ranges(rows: DataFrame) -> DataFrame:
    """Neighbours (id, tree, other) of rows (tree, key, id, region), sorted by ranges."""
    ranges = rows.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    near = store(ranges.mapInArrow(_neighbours, "tree int, id long, other long, key binary, region long"), "ranges")
    # A few rows of each task.
    order = Window.partitionBy("tree").orderBy("key", "id")
    before = [F.when(F.lag("region", k).over(order) == F.col("region"), F.lag("id", k).over(order)) for k in range(1, NEIGHBOURS + 1)]
    edges = near.where(F.col("key").isNotNull()).select("id", "tree", F.array(*before).alias("others"))
    return near.where(F.col("key").isNull()).select("id", "tree", "other").unionByName(edges.select("id", "tree", F.explode("others").alias("other")))


def candidates(classes: DataFrame) -> DataFrame:
    """classes: rows (id, signature).  Distinct rows (u, v, tree) with u < v; tree is the first in which they met."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring(F.col("signature"), t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("key")),
    )
    entries = classes.select("id", F.explode(keys).alias("e")).select("id", "e.tree", "e.key")
    entries = entries.withColumn("prefix", F.substring("key", 1, 4 * MIN_DEPTH))
    sizes = store(entries.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "regions")
    region = Window.partitionBy("tree", "prefix").orderBy("key", "id")
    near = entries.join(sizes.where(F.col("n") <= REGION).select("tree", "prefix"), ["tree", "prefix"]).select(
        "id", "tree", F.array(*[F.lag("id", k).over(region) for k in range(1, NEIGHBOURS + 1)]).alias("others")
    )
    out = near.select("id", "tree", F.explode("others").alias("other"))
    large = sizes.where(F.col("n") > REGION).select("tree", "prefix")
    if not large.isEmpty():
        rows = store(entries.join(large, ["tree", "prefix"]).select("tree", "key", "id", F.xxhash64("tree", "prefix").alias("region")), "large")
        out = out.unionByName(_in_ranges(rows))
    return (
        out.where(F.col("other").isNotNull() & (F.col("other") != F.col("id")))
        .groupBy(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"))
        .agg(F.min("tree").alias("tree"))
    )


def _near_in_size(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sets aren't too different in size to be alike."""
    of = lambda k: classes.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n{k}")).hint("merge")
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    return both.where(PERCENT * F.greatest("nu", "nv") <= 100 * F.least("nu", "nv")).select(pairs.columns)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are alike enough."""
    return _with_ends(pairs.select("u", "v"), sets).select("u", "v", "su", "sv").mapInArrow(_confirm, "u long, v long")


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda k: joined.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")).hint("merge")
    far = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v"))
    return far.select(pairs.columns)


def _of_ends(docs: DataFrame, pairs: DataFrame, blob: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """id, shingles of the ends of pairs, and of few other documents; blob: what is told of a set.

    A table of bounded size tells which texts aren't ends, so no text crosses the network.
    """
    needed = store(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "needed")
    table = docs.sparkSession.sparkContext.broadcast(bits.array_of(needed.select(F.xxhash64("id").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(bits.may_hold(table.value, batch.column("h").to_numpy())))
            for part in words.runs(some.column("text"), lower=True):
                blobs = [blob(s) for s in words.shingle_sets(part, WORDS)]
                ids = some.column("id").slice(part.lo, part.hi - part.lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text")
    return store(texts.where(F.col("id").isNotNull()).mapInArrow(run, "id long, shingles binary"), name)


def _sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    return _of_ends(docs, pairs, lambda s: s.tobytes(), "sets")


def _with_ends(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    of = lambda k: sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")).hint("merge")
    return pairs.join(of("u"), "u").join(of("v"), "v")


def _enough_forced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose forced shingles (32 bits each, which can only find more in common) allow PERCENT.

    Of the two lists one ends first in the order; what both sets hold up to there is in both lists, and no more than
    the rest of its set comes after.
    """
    for batch in batches:
        n = np.maximum(batch.column("nu").to_numpy(), batch.column("nv").to_numpy()).astype(np.int64)
        whole = batch.column("nu").to_numpy().astype(np.int64) + batch.column("nv").to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint32) for k in ("su", "sv"))
            keep[i] = (100 + PERCENT) * (np.isin(a, b).sum() + -(-PERCENT * n[i] // 100) - 1) >= PERCENT * whole[i]
        some = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([some.column(k) for k in ("u", "v", "common")], names=["u", "v", "common"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession):  # all that passes through Python is stored here
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    signed = store(signed_documents(docs), "signed")
    shingled = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = store(
        shingled.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("id"), F.any_value("signature").alias("signature"), F.any_value("n_shingles").alias("n_shingles")),
        "classes",
    )
    pairs = store(_near_in_size(candidates(classes.select("id", "signature")), classes), "pairs")
    sets = _sets(docs, pairs)
    links = store(_linked(pairs.where(F.col("tree") < FIRST_TREES), sets), "links")
    joined = store(components(links), "joined")
    # The other trees matter only where they connect what isn't connected.
    more = store(_linked(_apart(pairs.where(F.col("tree") >= FIRST_TREES), joined), sets), "links")
    if not more.isEmpty():
        joined = store(extended(joined, more), "joined")
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    rows = missed(docs, classes, joined, shared)
    for meet in (_with_outermost, _with_all):
        before = joined
        pairs = _met(meet(rows))
        if meet is _with_outermost:  # it meets for the sake of the others, so only pairs that share much count
            rest = F.ceil(PERCENT * F.greatest("nu", "nv") / 100) - 1
            pairs = pairs.where((100 + PERCENT) * (F.col("common") + rest) >= PERCENT * (F.col("nu") + F.col("nv")))
        pairs = store(pairs, "met")
        if pairs.isEmpty():
            continue
        lists = _of_ends(docs, pairs, lambda s: forced(s, *shared.value).astype(np.uint32).tobytes(), "lists")
        pairs = store(_with_ends(pairs, lists).mapInArrow(_enough_forced, "u long, v long, common long"), "missed")
        if pairs.isEmpty():
            continue
        sets = _sets(docs, pairs)
        for some in (_hubs, lambda p: p):
            more = store(_linked(some(_apart(pairs, joined)), sets), "links")
            if not more.isEmpty():
                joined = store(extended(joined, more), "joined")
        if meet is _with_outermost and joined is not before:
            rows = _still_mixed(rows, joined)
    joined = joined.withColumnRenamed("node", "id")
    told = classes.join(joined.hint("merge"), "id", "left").select("set_hi", "set_lo", F.coalesce("component", "id").alias("component_id"))
    return (
        signed.drop("signature").join(told, ["set_hi", "set_lo"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


#: Documents to drop are broadcast up to this many, and joined by shuffle beyond.
MAX_BROADCAST = 500_000


def clean(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates of a smaller doc_id; rows without a doc_id or shingles stay."""
    gone = store(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
