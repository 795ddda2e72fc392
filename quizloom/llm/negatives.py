"""Hard negatives by bit-sliced integer products.

Components become whole numbers, q = floor(256 x), and a score is the inner product of
two rows' numbers.  The anchors, a stated share of the ids, are cut into chunks of
bounded size; each chunk is broadcast and all rows pass by it twice, once for the
anchors' positives and once for their negatives.

Inside a task the rows' numbers are taken apart into bit-planes.  From the most
significant plane on, a product of one plane with all anchors of the chunk is added to
the scores; what the planes to come can still add lies between (2^b - 1) times the sum
of an anchor's negative numbers and of its positive ones.  Pairs whose interval misses
what the anchor still looks for are dropped: rows without a live pair leave the block,
and once few pairs live, only they go on.  What an anchor looks for tightens with every
block, since the task keeps its best so far.  A task hands on its best few per anchor,
and Spark ranks them.  All arithmetic is exact: products stay below 2**24 in floats,
below 2**53 in doubles, and are Python integers beyond.

Defined results: rows with a null id, label or vector, an empty vector, null or
non-finite entries, or another than the commonest width take no part; an anchor's other
rows are those with another id; repeated rows count as often as they occur, and a
repeated anchor is an anchor each time; no rows or no anchors give an empty result;
further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm import vectors
from quizloom.llm.scratch import new_dir, store

FACTOR = 256.0
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOWEST to HIGHEST hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
#: Bytes of the anchors' numbers that are broadcast at once, anchors at once, and pairs of a block.
CHUNK_BYTES, CHUNK, PAIRS = 1 << 24, 1 << 14, 1 << 21
#: Below this share of live pairs only they go on.
SPARSE = 1 / 32
#: Rows of a task's first block; its scores tighten what the next ones must reach.
FIRST = 256


def _kind(anchors: np.ndarray, bits: int) -> type:
    """The narrowest type in which every sum of a product with so many bits is exact."""
    most = int(sum(abs(int(v)) for v in np.abs(anchors).max(0))) << bits + 1 if len(anchors) else 0
    return np.float32 if most <= 1 << 24 else np.float64 if most <= 1 << 53 else object


def _bits(q: np.ndarray) -> int:
    """Bits of two's complement that hold every number of q."""
    return max(int(q.max(initial=0)).bit_length(), int(-1 - q.min(initial=0)).bit_length() if q.min(initial=0) < 0 else 0) + 1


def surviving_pairs(q: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs with low[anchor] <= score <= high[anchor]; plane by plane, the highest first."""
    bits = _bits(q)
    kind = _kind(anchors, bits)
    a = anchors.astype(kind)
    least, most = np.minimum(anchors.astype(object), 0).sum(1), np.maximum(anchors.astype(object), 0).sum(1)
    if kind is not object:  # a range beyond what any score can be is as good as its end
        edge = float(1 << (25 if kind is np.float32 else 54))
        least, most, low, high = (np.clip(v.astype(np.float64), -edge, edge) for v in (least, most, low, high))
    at, score = np.arange(len(q)), np.zeros((len(q), len(a)), kind)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for b in range(bits - 1, -1, -1):
        weight = -(1 << b) if b == bits - 1 else 1 << b
        weighed = a * (weight if kind is object else kind(weight))
        plane = ((q >> b) & 1).astype(kind)
        rest = (1 << b) - 1
        from_, to = low - rest * most, high - rest * least
        if kind is not object:
            from_, to = (np.clip(v, -edge, edge).astype(kind) for v in (from_, to))
        if pairs is None:
            score += plane @ weighed.T
            live = score >= from_
            live &= score <= to
            stays = live.any(1)
            if not stays.all():
                q, at, score, live = q[stays], at[stays], score[stays], live[stays]
            if not len(q) or b == 0 or np.count_nonzero(live) < SPARSE * live.size:
                pairs = np.nonzero(live)
                score = score[pairs]
        else:
            rows, which = pairs
            score = score + (plane[rows] * weighed[which]).sum(1)
            keep = (score >= from_[which]) & (score <= to[which])
            pairs, score = (rows[keep], which[keep]), score[keep]
    rows, which = pairs if pairs is not None else (np.zeros(0, int), np.zeros(0, int))
    return at[rows], which, score.astype(np.int64) if kind is not object else score


@dataclass
class Best:
    """The best rows of each list: highest scores first, ties by the smaller id."""

    lists: int
    most: int

    def __post_init__(self) -> None:
        self.key, self.ids, self.scores = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(self.lists, -np.inf).astype(object)  # the score that a list still takes

    def add(self, key: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(key):
            return
        key, ids, scores = np.concatenate([self.key, key]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, key))
        key, ids, scores = key[order], ids[order], scores[order]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(begins, np.diff(np.r_[begins, len(key)]))
        kept = place < self.most
        full = place == self.most - 1
        self.key, self.ids, self.scores = key[kept], ids[kept], scores[kept]
        self.least[key[full]] = scores[full].tolist()


def _blocks(batches: Iterator[pa.RecordBatch], anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, numbers) of runs of rows, a short one first."""
    rows, limit = FIRST, max(16, PAIRS // max(1, anchors))
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
        width = len(batch.column("embedding")[0]) if len(batch) else 1
        q = vectors.whole(vectors.matrix(batch.column("embedding"), width), FACTOR)
        at = 0
        while at < len(ids):
            yield ids[at : at + rows], labels[at : at + rows], q[at : at + rows]
            at, rows = at + rows, limit


@dataclass
class Chunk:
    """Anchors in the order of their labels."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray


def _clamped(scores: np.ndarray) -> pa.Array:
    return pa.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], pa.int64()) if scores.dtype == object else pa.array(scores)


def _positives(shared) -> Callable:  # noqa: ANN001
    """Each anchor's best other rows of its label among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: Chunk = shared.value
        best = Best(len(chunk.ids), POSITIVES)
        names = np.unique(chunk.labels)
        begins, ends = np.searchsorted(chunk.labels, names), np.searchsorted(chunk.labels, names, "right")
        for ids, labels, q in _blocks(batches, len(chunk.ids)):
            for name, lo, hi in zip(names, begins, ends, strict=True):
                mine = np.flatnonzero(labels == name)
                if not len(mine):
                    continue
                high = np.full(hi - lo, np.inf).astype(object)
                row, which, score = surviving_pairs(q[mine], chunk.q[lo:hi], best.least[lo:hi], high)
                row, which = ids[mine[row]], which + lo
                other = row != chunk.ids[which]
                best.add(which[other], row[other], score[other])
        if len(best.key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.key, pa.int32()), pa.array(chunk.ids[best.key]), pa.array(best.ids), _clamped(best.scores)],
                names=["anchor", "anchor_id", "positive_id", "positive_score"],
            )

    return run


def _negatives(shared) -> Callable:  # noqa: ANN001
    """The best rows of other labels within each positive's range among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, low, high = shared.value  # low, high: by anchor and positive, empty ranges where there is none
        best = Best(low.size, NEGATIVES)
        widest = high.max(1)
        for ids, labels, q in _blocks(batches, len(chunk.ids)):
            needed = np.maximum(low, best.least.reshape(low.shape))
            row, which, score = surviving_pairs(q, chunk.q, needed.min(1), widest)
            other = labels[row] != chunk.labels[which]
            row, which, score = ids[row[other]], which[other], score[other]
            for p in range(POSITIVES):
                fits = (score >= needed[which, p]) & (score <= high[which, p])
                best.add(which[fits] * POSITIVES + p, row[fits], score[fits])
        if len(best.key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.key // POSITIVES, pa.int32()), pa.array(best.key % POSITIVES + 1, pa.int32()), pa.array(best.ids), _clamped(best.scores)],
                names=["anchor", "place", "negative_id", "negative_score"],
            )

    return run


def ranges(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score with LOWEST * positive <= 100 * score <= HIGHEST * positive; scores: Python integers."""
    return -((-LOWEST * scores) // 100), (HIGHEST * scores) // 100


def rows_taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (moved on where vec_id is divisible by 7) and embedding of the rows that take part."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.finite())
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), "embedding")
    return rows.where(F.size("embedding") == vectors.commonest_width(rows))


def _chunks(rows: DataFrame, every: int) -> Iterator[Chunk]:
    """The anchors, at most CHUNK and CHUNK_BYTES at a time."""
    anchors = rows.where(F.col("vec_id") % every == 0)
    count, width = anchors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not count:
        return
    most = max(1, min(CHUNK, CHUNK_BYTES // (8 * width)))
    number = F.monotonically_increasing_id()
    dealt = anchors.repartition(-(-count // most)).select("*", F.shiftright(number, 33).alias("part"), (number % (1 << 33)).alias("at"))
    dealt = store(dealt.select("vec_id", "label", "embedding", "part", F.expr(f"at div {most}").alias("cut")), "anchors")
    for part, cut in sorted(map(tuple, dealt.select("part", "cut").distinct().collect())):
        table = dealt.where((F.col("part") == part) & (F.col("cut") == cut)).toArrow()  # most rows at most
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        q = vectors.whole(vectors.matrix(table.column("embedding").combine_chunks(), width), FACTOR)
        yield Chunk(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), q)


def _first(found: DataFrame, keys: list[str], score: str, row: str, most: int, place: str) -> DataFrame:
    """The best rows of each key among what the tasks found, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(row))
    return found.withColumn(place, F.row_number().over(order)).where(F.col(place) <= most)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(embeddings: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """One row per anchor, positive and negative, rank numbering the negatives of a pair from 1."""
    spark = embeddings.sparkSession
    rows = rows_taking_part(embeddings)
    path = None
    for chunk in _chunks(rows, every):
        shared = spark.sparkContext.broadcast(chunk)
        found = rows.mapInArrow(_positives(shared), "anchor int, anchor_id long, positive_id long, positive_score long")
        positives = store(_first(found, ["anchor"], "positive_score", "positive_id", POSITIVES, "place"), "positives")
        listed = positives.select("anchor", "place", "positive_score").toArrow()  # POSITIVES times the chunk at most
        low = np.full((len(chunk.ids), POSITIVES), np.inf).astype(object)
        high = -low
        at = (listed.column("anchor").to_numpy(), listed.column("place").to_numpy() - 1)
        low[at], high[at] = ranges(np.array(listed.column("positive_score").to_pylist(), object))
        with_ranges = spark.sparkContext.broadcast((chunk, low, high))
        found = rows.mapInArrow(_negatives(with_ranges), "anchor int, place int, negative_id long, negative_score long")
        negatives = _first(found, ["anchor", "place"], "negative_score", "negative_id", NEGATIVES, "rank")
        result = negatives.join(positives, ["anchor", "place"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
        )
        path = path or new_dir(spark, "hard-negatives")
        result.write.mode("append").parquet(path)
        shared.unpersist()
        with_ranges.unpersist()
    return spark.read.schema(SCHEMA).parquet(path) if path else spark.createDataFrame([], SCHEMA)
