"""Whitening of embeddings by an exact integer scatter.

Entries become whole numbers x = floor(64 c) + 1000000.  Tasks subtract the shift and
add up y = x - shift and all products of two dimensions without rounding: y is cut
into digits of 20 bits, whose products over 4,096 rows stay below 2**53, so a float
matrix product of two digits is exact, and Python's integers hold the totals.  They
leave a task as limbs of 32 bits that Spark sums as longs.  From the sums the driver
forms n XᵀX - SSᵀ exactly, and converts only this to float for eigh.  What reaches it
are width**2 numbers, whatever the rows; MAX_WIDTH bounds them.

Defined results: rows whose vector is null, empty or holds null or non-finite entries
are dropped, and so are vectors of another than the commonest width (of equally common
ones, the wider); entries beyond 2**62 / 64 count as that; repeated rows and null ids
count as any row; directions without variance (below 1e-12 of the largest) are no
components; deviation is null where it doesn't fit a long; no rows give an empty
result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm import vectors
from quizloom.llm.scratch import store

FACTOR, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
MAX_WIDTH = 4096
#: Rows and bits of a digit: a sum of ROWS products of two digits is exact in a double.
ROWS, DIGIT = 1 << 12, 20
LIMB = 32
#: Eigenvalues up to this share of the largest are rounding, not variance.
NO_VARIANCE = 1e-12


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """y as the sum of digits[k] << 20 k, each of magnitude below 2**20, as doubles."""
    out, rest = [], y
    while True:
        digit = rest & ((1 << DIGIT) - 1) if np.abs(rest).max(initial=0) >= 1 << DIGIT else rest
        out.append(digit.astype(np.float64))
        rest = (rest - digit) >> DIGIT
        if not rest.any():
            return out


def exact_scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and products of all columns with each other, as Python integers; y: longs, one row each."""
    width = y.shape[1]
    sums, products = np.zeros(width, object), np.zeros((width, width), object)
    for at in range(0, len(y), ROWS):
        digits = _digits(y[at : at + ROWS])
        for i, left in enumerate(digits):
            sums += left.sum(0).astype(np.int64).astype(object) * (1 << DIGIT * i)
            for j, right in enumerate(digits):
                products += (left.T @ right).astype(np.int64).astype(object) * (1 << DIGIT * (i + j))
    return sums, products


def _limbs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, limbs): the values are the sum of limbs << 32 k; the last limb has the sign."""
    k = 0
    while True:
        fits = all(-(1 << LIMB) < v < 1 << LIMB for v in values)
        limb = values if fits else np.array([v & ((1 << LIMB) - 1) for v in values], object)
        yield k, limb.astype(np.int64)
        if fits:
            return
        values, k = (values - limb) // (1 << LIMB), k + 1


def _partial(width: int) -> Callable:
    """Per task: limbs of the sums (i = -1) and of the products i <= j; i = j = -1 is the number of rows."""
    upper = np.triu_indices(width)
    i = np.concatenate([[-1], np.full(width, -1), upper[0]])
    j = np.concatenate([[-1], np.arange(width), upper[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = vectors.whole(vectors.matrix(batch.column("embedding"), width), FACTOR)
            more_sums, more_products = exact_scatter(y)
            n, sums, products = n + len(y), sums + more_sums, products + more_products
        if n:
            for k, limb in _limbs(np.concatenate([np.array([n], object), sums, products[upper]])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), k), pa.int32()), pa.array(limb)],
                    names=["i", "j", "k", "limb"],
                )

    return run


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of y, by dimension
    eigenvalues: np.ndarray  # falling
    components: np.ndarray  # one column each, unit length
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as longs where they fit, else as Python integers."""
        largest = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest < 1 << 62 else object
        return y.astype(kind) * self.n - np.array(self.sums, object).astype(kind)

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        largest = max((int(np.abs(centred).max(initial=0)), 1))
        if centred.dtype == object or largest**2 * self.width >= 1 << 63:
            exact = (centred.astype(object) ** 2).sum(1)
            return [int(v) if v < 1 << 63 else None for v in exact]
        return (centred**2).sum(1).tolist()

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ (self.components / np.sqrt(self.eigenvalues))


def scatter(rows: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums of y = floor(64 c), and n XᵀX - SSᵀ, all exact."""
    partial = rows.select("embedding").mapInArrow(_partial(width), "i int, j int, k int, limb long")
    found = partial.groupBy("i", "j", "k").agg(F.sum("limb").alias("limb")).collect()  # width**2 limbs
    total: dict[tuple[int, int], int] = {}
    for i, j, k, limb in found:
        total[i, j] = total.get((i, j), 0) + (limb << LIMB * k)
    n = total.get((-1, -1), 0)
    sums = [total.get((-1, j), 0) for j in range(width)]
    return n, sums, [[n * total.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(width)] for i in range(width)]


def fit(embeddings: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The components of all rows that take part; None where no row does."""
    rows = embeddings.select("embedding").where(vectors.finite())
    width = vectors.commonest_width(rows)
    if width > MAX_WIDTH:
        raise ValueError(f"vectors have {width} entries; the scatter is made for {MAX_WIDTH} at most")
    if not width:
        return None
    n, sums, exact = scatter(rows.where(F.size("embedding") == width), width)
    covariance = np.array([[v / (n * n) for v in row] for row in exact])  # of two integers, so rounded once
    values, components = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, components = values[order], components[:, order]
    keep = min(most, int((values > NO_VARIANCE * max(values[0], 0)).sum()))
    trace = sum(exact[i][i] for i in range(width)) / (n * n)
    return Whitening(n, sums, values[:keep], components[:, :keep], trace)


def _taking_part(embeddings: DataFrame, model: Whitening) -> DataFrame:
    return embeddings.where(vectors.finite() & (F.size("embedding") == model.width))


def identity_error(embeddings: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; tasks centre on their own means, which are then put together."""
    k = len(model.eigenvalues)
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = model.whitened(model.centred(vectors.whole(vectors.matrix(batch.column("embedding"), model.width), FACTOR)))
            if not len(z):
                continue
            own = z.mean(0)
            z, shift = z - own, own - mean
            products += z.T @ z + np.outer(shift, shift) * (m * len(z) / (m + len(z)))
            mean, m = mean + shift * (len(z) / (m + len(z))), m + len(z)
        if m:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int32()) for x in upper), pa.array(np.full(len(upper[0]), m)), *(pa.array(mean[x]) for x in upper), pa.array(products[upper])],
                names=["i", "j", "m", "mean_i", "mean_j", "c"],
            )

    rows = _taking_part(embeddings.select("embedding"), model)
    partial = store(rows.mapInArrow(run, "i int, j int, m long, mean_i double, mean_j double, c double"), "whitened-scatter")
    means = partial.groupBy("i", "j").agg(
        (F.sum(F.col("m") * F.col("mean_i")) / F.sum("m")).alias("all_i"), (F.sum(F.col("m") * F.col("mean_j")) / F.sum("m")).alias("all_j")
    )
    apart = F.col("m") * (F.col("mean_i") - F.col("all_i")) * (F.col("mean_j") - F.col("all_j"))
    covariance = partial.join(means, ["i", "j"]).groupBy("i", "j").agg((F.sum(F.col("c") + apart) / F.sum("m")).alias("v"))
    worst = covariance.agg(F.max(F.abs(F.col("v") - (F.col("i") == F.col("j")).cast("double")))).first()[0]
    return float(worst or 0.0)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part and component, with the vector's whitened coordinate."""
    model = fit(embeddings, most)
    if model is None or not len(model.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(embeddings, model)
    k = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), ROWS):
                batch = whole_batch.slice(at, ROWS)
                centred = model.centred(vectors.whole(vectors.matrix(batch.column("embedding"), model.width), FACTOR))
                z = model.whitened(centred)
                each = np.repeat(np.arange(len(z)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))),
                        pa.array(np.full(len(each), model.n)),
                        pa.array(model.deviation(centred), pa.int64()).take(pa.array(each)),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, len(z))),
                        pa.array(np.full(len(each), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rows = _taking_part(embeddings, model).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, SCHEMA)
