"""Bloom filters of 64-bit hashes, as bounded literals of a plan or as bounded arrays.

A table has ``per_hash`` bits for each hash, and ``MOST`` bits at most, whatever the number of
hashes: beyond that it lets more through, and never holds anything back.  What it
lets through is always decided by a join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MB.
MOST = 1 << 25
PROBES = 4


def one(n: Column) -> Column:
    """The long with bit n alone."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def _place(h: Column, probe: int, cells: int) -> tuple[Column, Column]:
    """Cell and bit of a probe."""
    part = F.shiftrightunsigned(h, 13 * probe)
    cell = F.shiftrightunsigned(part, 6).bitwiseAND(F.lit(cells - 1).cast("bigint")).cast("int")
    return cell, part.bitwiseAND(F.lit(63).cast("bigint")).cast("int")


def _cells(hashes: DataFrame, column: str, per_hash: int) -> np.ndarray:
    """The table as longs of 64 bits each, combined on the executors."""
    n = max(1, hashes.count())
    size = 64
    while size < min(per_hash * n, MOST):
        size *= 2
    cells = size // 64
    places = F.array(*[F.struct(*[c.alias(k) for c, k in zip(_place(F.col(column), i, cells), ("cell", "bit"), strict=True)]) for i in range(PROBES)])
    marks = hashes.select(F.explode(places).alias("p")).groupBy(F.col("p.cell").alias("cell")).agg(F.bit_or(one(F.col("p.bit"))).alias("b")).toArrow()
    table = np.zeros(cells, np.int64)
    table[marks.column("cell").to_numpy()] = marks.column("b").to_numpy()
    return table


def table_of(hashes: DataFrame, column: str, per_hash: int = 32) -> Callable[[Column], Column]:
    """A function from a hash column to whether it may be one of hashes (a frame of distinct, well-mixed longs)."""
    cells = _cells(hashes, column, per_hash)
    table = F.split(F.lit(",".join(map(str, cells.tolist()))), ",").cast("array<bigint>")

    def maybe(h: Column) -> Column:
        hit = F.lit(True)
        for i in range(PROBES):
            cell, bit = _place(h, i, len(cells))
            hit = hit & (F.get(table, cell).bitwiseAND(one(bit)) != 0)
        return hit

    return maybe


def array_of(hashes: DataFrame, column: str, per_hash: int = 16) -> np.ndarray:
    """The same table for ``may_hold``; it is no part of a plan."""
    return _cells(hashes, column, per_hash).view(np.uint64)


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of those that the table was made of."""
    hit = np.ones(len(h), bool)
    for i in range(PROBES):
        part = h.view(np.uint64) >> np.uint64(13 * i)
        cell = (part >> np.uint64(6)) & np.uint64(len(table) - 1)
        hit &= (table[cell.astype(np.int64)] >> (part & np.uint64(63))) & np.uint64(1) == 1
    return hit
