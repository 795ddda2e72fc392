"""Connected components: in one task where edges are few, else by large-star and small-star rounds.

Up to ``ONE_TASK`` edges (some megabytes) are contracted by one task.  More go through
alternating rounds: each keeps the components and shortens paths; the rounds end when
an edge table repeats itself.  Minima are combined before the shuffle and joined back,
so a hub's neighbours are never gathered in one place.  Each half of a round is written
to the shared folder, so a lost executor costs one at most.  Both ways give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quizloom.llm.scratch import store


#: Edges that one task contracts at most.
ONE_TASK = 500_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        for end in (least[a], least[b], a, b):
            np.minimum.at(now, end, low)
        now = now[now]
        if (now == least).all():
            return nodes, nodes[least]
        least = now


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[b.column(k).to_numpy() for k in ("u", "v")] for b in batches]
    if held:
        nodes, least = labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # The labels grow with the edges: never broadcast.
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _marked(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """edges, stored, and what tells whether two edge tables are the same; both come from one job."""
    seen = Observation()
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    out = store(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), name)
    return out, (seen.get["n"], seen.get["total"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: rows (u, v), no nulls.  Rows (node, component) for each node of an edge, by its smallest reachable node."""
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = _marked(now, "edges")
    if before[0] <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_contract, "node long, component long")
    for _ in range(max_rounds):
        now, mark = _marked(_small_star(store(_large_star(now), "large_star")), "small_star")
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def extended(joined: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links (u, v)."""
    return components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links.select("u", "v")))
