"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The model is fitted by one task on a sample of the labelled training rows that is
bounded in rows (``SAMPLE``) and bytes (``SAMPLE_BYTES``).  Where it holds a smaller
share of one class than of the other, rows are weighed by class, so that rates are
those of all training rows.  The sample has three parts: one finds the lexicon
(words and word beginnings that toxic documents hold far more often), one grows the
trees, one calibrates.  It is a few hundred
kilobytes whatever the corpus holds, and every document is scored by it in one
pass without a shuffle.

Features: density of the seed lexicon and of the learned one, strongest learned
words, second-person words and how often lexicon words stand near them, capitals,
punctuation, exclamation and obfuscation (symbols or digits inside words) rates.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1.  Labels, lang,
source and doc_id are no inputs of a score.

Defined results: a null or empty text has all densities 0 and gets the score of
such a document; rows with one doc_id are scored by their own text, and any toxic
label of a doc_id counts; a null doc_id is held out; without labels of both
classes every score is the rate of the toxic ones, or 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm import words

THRESHOLD = 0.7
#: Rows of each class that the model is fitted on at most.
SAMPLE = {1: 3000, 0: 6000}
#: Characters of a text that the sample takes in, and bytes of all its texts; longer texts are scored like all others.
SAMPLE_TEXT, SAMPLE_BYTES = 200_000, 1 << 26
BUCKETS = 1 << 22
LEXICON = 40_000
NEAR = 5
TREES, LEVELS, RATE, BINS = 60, 3, 0.2, 32
BATCH_CHARS = 1 << 20

# A seed lexicon and second-person words.
SEED = (
    "idiot idiots stupid moron morons dumb trash scum loser losers pathetic worthless disgusting clown fool ugly filthy garbage "
    "hate kill shut dumm dummkopf abschaum widerlich blöd imbécile stupide ordure idiota estúpido basura asqueroso imbécil"
).split()
SECOND = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre usted ustedes tus ti".split()


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def _word_hash(texts: list[str]) -> np.ndarray:
    run = next(words.runs(pa.array([" ".join(texts)]), lower=True, letters=True))
    return np.sort(run.hashes())


def _entries(run: words.Run) -> np.ndarray:
    """Buckets of each word: itself and its first 4, 5 and 6 bytes; a shorter word stands for its own beginnings."""
    size = run.stop - run.start
    every = [run.hashes()]
    for k in (4, 5, 6):
        stop = np.where(size > k, run.start + k, run.stop)
        every.append(run.hashes(stop) + np.uint64(k) * (size > k))
    return (words.mix(np.stack(every, 1)) >> np.uint64(42)).astype(np.int64)


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin of each split, values of the leaves
    base: float  # margin of the first tree; without trees the rate of toxic rows
    knots: np.ndarray  # margins and their calibrated rates
    rates: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree[2][_leaf(tree, binned)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:  # base is the rate then
            return np.full(len(x), self.base)
        m = self.margin(x)
        # A small share of the margin keeps the order inside the calibration's steps.
        return np.clip(0.98 * np.interp(m, self.knots, self.rates) + 0.02 / (1 + np.exp(-m)), 0, 1)


def _leaf(tree, binned: np.ndarray) -> np.ndarray:
    node = np.zeros(len(binned), np.int64)
    for _ in range(LEVELS):
        node = 2 * node + 1 + (binned[np.arange(len(binned)), tree[0][node]] > tree[1][node])
    return node - (2**LEVELS - 1)


def _rates(data: np.ndarray, lo: int, hi: int) -> list[float]:
    part = data[lo:hi]
    n = max(1, len(part))
    upper = np.count_nonzero((part >= 65) & (part <= 90))
    letter = ((part | 32) >= 97) & ((part | 32) <= 122) | (part >= 128)
    mark = (part > 32) & ~letter & ~((part >= 48) & (part <= 57))
    inside = (np.count_nonzero(letter[:-2] & ~letter[1:-1] & (part[1:-1] > 32) & letter[2:]) if len(part) > 2 else 0)
    return [upper / n, np.count_nonzero(mark) / n, np.count_nonzero(part == 33) / n, inside / n]


def features(texts: pa.Array, model: Model) -> np.ndarray:
    """One row of features per text."""
    seed, second = _word_hash(SEED), _word_hash(SECOND)
    out = []
    raw = words.runs(texts, lower=False, letters=False)
    for run, asis in zip(words.runs(texts, lower=True, letters=True), raw, strict=True):
        hashed = run.hashes()
        hit, you = np.isin(hashed, seed), np.isin(hashed, second)
        if len(model.buckets):
            entries = _entries(run)
            at = np.minimum(np.searchsorted(model.buckets, entries), len(model.buckets) - 1)
            weight = np.where(model.buckets[at] == entries, model.weights[at], 0.0).max(1) if len(entries) else np.zeros(0)
        else:
            weight = np.zeros(len(hashed))
        for i in range(run.hi - run.lo):
            a, b = run.first[i], run.first[i + 1]
            n = max(1, b - a)
            w, bad, to = weight[a:b], hit[a:b] | (weight[a:b] > 2), you[a:b]
            top = np.sort(w)[-5:][::-1] if b > a else np.zeros(0)
            top = np.pad(top, (0, 5 - len(top)))
            reach = np.convolve(to, np.ones(2 * NEAR + 1), "same") > 0 if b - a > 2 * NEAR else np.full(b - a, to.any())
            lo, hi = asis.offsets[i], asis.offsets[i + 1]
            out.append(
                [
                    hit[a:b].sum() / n, np.log1p(hit[a:b].sum()), w.sum() / n, top[0], top[1], top.mean(), (w > 1.5).sum() / n,
                    np.log1p((w > 2.5).sum()), to.sum() / n, (bad & reach).sum() / n, np.log1p(b - a), *_rates(asis.data, lo, hi),
                ]
            )
    return np.array(out, np.float64).reshape(-1, 15)


def _find_lexicon(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that toxic documents hold more often, with their log ratios."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for run in words.runs(texts, lower=True, letters=True):
        entries = _entries(run)
        row = np.repeat(run.row_of_word(), entries.shape[1])
        pairs = np.unique(row * BUCKETS + entries.ravel())
        doc, bucket = pairs // BUCKETS, pairs % BUCKETS
        for c in (0, 1):
            np.add.at(counts[c], bucket[y[run.lo + doc] == c], 1)
    toxic = np.flatnonzero(counts[1] >= 4)
    ratio = np.log((counts[1][toxic] + 0.5) / ((y == 1).sum() + 1)) - np.log((counts[0][toxic] + 0.5) / ((y == 0).sum() + 1))
    # Chance: one standard error of the log ratio is taken off.
    ratio -= np.sqrt(1 / (counts[1][toxic] + 0.5) + 1 / (counts[0][toxic] + 0.5)) * 0.5
    keep = np.argsort(-ratio)[:LEXICON]
    keep = np.sort(keep[ratio[keep] > 0.7])
    return toxic[keep], ratio[keep]


def _grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, n_bins: int):
    """One tree by the usual second-order gain; a node that can't gain sends all rows left."""
    inner = 2**LEVELS - 1
    split, at, leaf = np.zeros(inner, np.int64), np.full(inner, n_bins, np.int64), np.zeros(2**LEVELS)
    node = np.zeros(len(binned), np.int64)
    for k in range(inner):
        rows = np.flatnonzero(node == k)
        best = 1e-6
        g, h = gradient[rows], hessian[rows]
        gain0 = g.sum() ** 2 / (h.sum() + 1)
        for j in range(binned.shape[1]) if len(rows) >= 10 else ():
            gl = np.cumsum(np.bincount(binned[rows, j], g, n_bins))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h, n_bins))[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - gain0
            if gain.max() > best:
                best, split[k], at[k] = gain.max(), j, gain.argmax()
        node[rows] = 2 * k + 1 + (binned[rows, split[k]] > at[k])
    leaves = node - inner
    g, h = np.bincount(leaves, gradient, 2**LEVELS), np.bincount(leaves, hessian, 2**LEVELS)
    return split, at, RATE * g / (h + 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y over x, by pooling adjacent violators; each row counts as its weight, or once."""
    weight = np.ones(len(y)) if weight is None else weight
    at, which = np.unique(x, return_inverse=True)  # rows with one x are one point
    sums, counts = np.bincount(which, weight * y), np.bincount(which, weight)
    pools: list[list[float]] = []  # sum, count, first x, last x
    for x0, total, n in zip(at.tolist(), sums.tolist(), counts.tolist(), strict=True):
        pools.append([total, n, x0, x0])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            total, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2], last]
    knots = [(p[k], p[0] / p[1]) for p in pools for k in (2, 3)]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def train(texts: pa.Array, y: np.ndarray, part: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """part: 0 finds the lexicon, 1 grows trees, 2 calibrates; weight: of each row, in the latter two."""
    weight = np.ones(len(y)) if weight is None else weight
    rate = float(y.mean()) if len(y) else 0.0
    model = Model(np.zeros(0, np.int64), np.zeros(0), [], [], rate, np.zeros(0), np.zeros(0))
    if min((y[part == p] == c).sum() for p in (0, 1, 2) for c in (0, 1)) == 0:
        part = np.zeros(len(y), np.int64)
        if len(set(y.tolist())) < 2:
            return model
    of = lambda p: part == p if part.any() else np.ones(len(y), bool)
    pick = lambda p: (texts.filter(pa.array(of(p))), y[of(p)], weight[of(p)])
    model.buckets, model.weights = _find_lexicon(*pick(0)[:2])
    some, target, times = pick(1)
    times = times / times.mean()
    x = features(some, model)
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)], 1)
    model.base = float(np.log(((times * target).sum() + 1) / ((times * (1 - target)).sum() + 1)))
    margin = np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, times * (target - p), times * p * (1 - p), BINS + 1)
        model.trees.append(tree)
        margin += tree[2][_leaf(tree, binned)]
    some, target, times = pick(2)
    model.knots, model.rates = isotonic(model.margin(features(some, model)), target.astype(float), times)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most SAMPLE training rows of each class, which are those with the smallest hashes.

    One task trains it; the driver gets the model alone.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Ids and labels alone choose the rows; the threshold on the hash bounds the sample before texts are read.
    known = known.withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
    picked = None
    for y, most in SAMPLE.items():
        one = known.where(F.col("y") == y).orderBy("h", "doc_id").limit(most)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_TEXT)
    # The right side has 9,000 rows at most.
    rows = texts.join(F.broadcast(picked), "doc_id").select("text", "y", "h", "doc_id").orderBy("h", "doc_id", "text").limit(2 * sum(SAMPLE.values()))
    rows = rows.select("text", "y", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(10)).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, left = [], SAMPLE_BYTES
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            kept.append(batch.slice(0, int(np.searchsorted(size, left, "right"))))
            left -= int(size[-1]) if len(size) else 0
            if left <= 0:
                break
        if not any(b.num_rows for b in kept):
            return
        table = pa.Table.from_batches(kept).combine_chunks()
        y = table.column("y").to_numpy()
        part = np.array([0, 0, 0, 0, 0, 1, 1, 1, 2, 2])[table.column("part").to_numpy().astype(np.int64)]
        share = {c: max(1.0, totals.get(c, 0) / max(1, int((y == c).sum()))) for c in SAMPLE}  # rows that one of the sample stands for
        model = train(pa.concat_arrays(table.column("text").chunks), y, part, np.where(y == 1, share[1], share[0]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = rows.mapInArrow(run, "model binary").collect()  # one row
    if not got:
        return train(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pickle.loads(got[0]["model"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.score(features(batch.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(got, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (~learnable(F.col("doc_id"))).alias("held_out"), "text")
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the model rejects."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(features(batch.column(at), shared.value)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
