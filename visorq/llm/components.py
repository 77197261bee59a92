"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


#: Edges up to this number (16 MB) are closed by one task; more of them by distributed steps.
ONE_TASK = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it is connected with) of the edges."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = np.arange(len(nodes)).tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.column_stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    if held:
        edges = np.concatenate(held)
        edges = edges[edges[:, 0] != edges[:, 1]]
        yield pa.record_batch([pa.array(x) for x in union_find(edges[:, 0], edges[:, 1])], names=["node", "component"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: every node's neighbours are tied to the least of them.

    The minimum per node is a map-side combined aggregation; the join that hands it back is an inner
    join that adaptive execution can split, so a node with very many neighbours meets in no one task.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 50, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component), stored: for each node of an edge (a, b), the least node it is connected with.

    Self loops and repeated edges are allowed; an empty edge table gives an empty result. ``edges`` are
    stored; few of them, by count, go to one task. Beyond, each round is stored in the shared folder and
    the round before deleted. Rounds grow with the logarithm of the largest component. Both ways give the
    same rows.
    """
    if edges.count() <= one_task:
        return materialize(edges.select("a", "b").coalesce(1).mapInArrow(_closed, "node long, component long"), "components")
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    for _ in range(most_rounds):
        before, edges = edges, materialize(_stars(_stars(edges, True), False), "stars")
        discard(before)
        # settled: no node has two centres, and no centre has one
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e"))
        uses = ends.groupBy("e.x").agg(F.sum("e.out").alias("n_out"), F.min("e.out").alias("least_out"))
        if not uses.filter("n_out > 1 or (n_out = 1 and least_out = 0)").agg(F.count(F.lit(1))).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    out = materialize(
        edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
            edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        ),
        "components",
    )
    discard(edges)
    return out
