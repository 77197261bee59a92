"""Nearest neighbours over a proximity graph, built and searched in rounds of joins.

The graph is an edge table (node, to, dist). It starts from groups of nodes that are near the same rows and is bettered by
NN-descent: the neighbours of a node, forward and backward, are compared with each other, and each keeps its nearest, until
a round gains next to nothing. A node is shipped with its vector to ``CELLS`` groups at the start, and to some 32 in a round. A search keeps, for each query, the rows it has compared; each round expands the best of its beam that are not yet
expanded, and it ends when the beam holds none. Work is bounded by the degree and the beam, never by a group's size:
a node's backward neighbours beyond the degree are those farther away, and its forward edges always stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored
from .blocks import matrix
from .vectors import cells_of

_EDGES = "node long, to long, dist double"
#: Rows for each row that starting groups gather around; such rows at most; groups that a node joins; rows of a group at most.
LEAF, CENTERS, CELLS, GROUP = 256, 4096, 3, 2000
#: Rows whose distances to a group are taken at once; the share of the distances that a round must gain for another one.
SLICE, GAIN = 256, 0.001


def sorted_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table | pa.RecordBatch]:
    """The runs of equal keys of a sorted stream; one run is held at a time, and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k)
            x = x.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)]) if held else batch.slice(a, b - a)
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(ids: np.ndarray, v: np.ndarray, bar: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, id, distance) of each row's ``most`` nearest others in the group, where they are nearer than what it has (bar)."""
    square, k = (v * v).sum(1), min(most + 1, len(v))
    for x in range(0, len(v), SLICE):
        own, q = ids[x : x + SLICE], v[x : x + SLICE]
        near = square - 2 * q @ v.T
        near[own[:, None] == ids[None, :]] = np.inf
        at = np.argpartition(near, k - 1, axis=1)[:, :k] if k < len(v) else np.tile(np.arange(k), (len(q), 1))
        d = np.sqrt(((v[at] - q[:, None, :]) ** 2).sum(2))
        r, c = np.nonzero((d < bar[x : x + SLICE, None]) & (own[:, None] != ids[at]))
        yield own[r], ids[at[r, c]], d[r, c]


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """All pairs inside each group, in both directions; no node keeps more than ``most`` of them."""
    out, size = [], 0

    def flush() -> pa.RecordBatch:
        cols = [np.concatenate([o[i] for o in out]) for i in range(3)]
        return pa.record_batch([pa.array(c) for c in cols], names=["node", "to", "dist"])

    for run in sorted_runs(batches, "g"):
        for part in _pairs(run["id"].to_numpy(), matrix(run["v"]).astype(float), run["bar"].to_numpy(), most):
            out.append(part)
            size += len(part[0])
            if size > 50_000:
                yield flush()
                out, size = [], 0
    if size:
        yield flush()


def _nearest_of(edges: DataFrame, most: int) -> DataFrame:
    """Each node's ``most`` nearest distinct neighbours."""
    order = Window.partitionBy("node").orderBy("dist", "to")
    return edges.dropDuplicates(["node", "to"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")


def _compared(groups: DataFrame, most: int) -> DataFrame:
    """groups: g, id, v, bar."""
    return groups.repartition("g").sortWithinPartitions("g").mapInArrow(lambda batches: _compare(batches, most), _EDGES)


def _groups(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """g, id, v: each node in the groups of the ``CELLS`` rows, of some taken by a hash, that are nearest to it. A large group
    is cut by a hash of the ids, so copies of one vector fill no task."""
    if n <= GROUP:
        return nodes.withColumn("g", F.lit(0).cast("long"))
    centers = nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(CENTERS, -(-n // LEAF))).collect()
    near = cells_of(nodes.sparkSession, np.array([r["v"] for r in centers]))
    dealt = stored(nodes.select("id", "v", F.explode(near(F.col("v"), F.lit(CELLS))).alias("cell")), "graph-cells")
    cuts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("cuts"))
    return dealt.join(F.broadcast(cuts), "cell").select((F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.col("cuts"))).alias("g"), "id", "v")


def both_ways(edges: DataFrame, degree: int) -> DataFrame:
    """(node, to, dist): the forward edges, and of the backward ones each node's ``degree`` nearest."""
    back = _nearest_of(edges.select(F.col("to").alias("node"), F.col("node").alias("to"), "dist"), degree)
    return edges.unionByName(back).dropDuplicates(["node", "to"])


def build(rows: DataFrame, degree: int = 16, rounds: int = 5, id_col: str = "vec_id", vec: str = "features", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), both stored: nodes id, v; edges node, to, dist with up to ``degree`` forward neighbours of each
    node and as many backward."""
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    lossless = vectors.agg(F.bool_and(F.col("v").eqNullSafe(F.col("v").cast("array<float>").cast("array<double>")))).first()[0]
    nodes = stored(vectors.withColumn("v", F.col("v").cast("array<float>")) if lossless else vectors, "graph-nodes")
    far = F.lit(float("inf"))
    edges = stored(_nearest_of(_compared(_groups(nodes, nodes.count(), seed).withColumn("bar", far), degree), degree), "graph-edges")
    reach = lambda x: x.agg(F.count(F.lit(1)), F.sum("dist")).first()
    have = reach(edges)
    for _ in range(rounds):
        bar = edges.groupBy(F.col("node").alias("id")).agg(F.when(F.count(F.lit(1)) < degree, far).otherwise(F.max("dist")).alias("bar"))
        held = nodes.join(bar, "id", "left").withColumn("bar", F.coalesce("bar", far))
        near = both_ways(edges, degree).select(F.col("node").alias("g"), F.col("to").alias("id"))
        better = _compared(near.join(held, "id").select("g", "id", "v", "bar"), degree)
        before, edges = edges, stored(_nearest_of(edges.unionByName(better), degree), "graph-edges")
        discard(before)
        had, have = have, reach(edges)
        if have[0] == had[0] and (have[1] or 0) >= (had[1] or 0) * (1 - GAIN):
            break
    graph = stored(both_ways(edges, degree), "graph")
    discard(edges)
    return nodes, graph


def save(path: str, nodes: DataFrame, edges: DataFrame) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("node").sortWithinPartitions("node").write.mode("overwrite").parquet(f"{path}/edges")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a stored graph; raises where there is none."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def _distance(a: str, b: str) -> Column:
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(square)


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, beam: int = 64, wide: int = 16, entries: int = 32, id_col: str = "vec_id", vec: str = "features", skip_self: bool = False) -> DataFrame:
    """id, nn_id, dist, compared: the nearest row found, and with how many rows the query was compared.

    beam: rows per query among which unexpanded ones are followed; wide: of these, expanded in one round; entries: nodes, by
    a hash of their ids, from which all searches start. skip_self: a row isn't its own answer, yet its edges are followed."""
    asked = stored(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("q")), "graph-queries")
    first = F.broadcast(nodes.orderBy(F.xxhash64("id", F.lit("entry")), "id").limit(entries).select(F.col("id").alias("to"), "v"))
    unseen = F.lit(False).alias("done")
    seen = stored(asked.join(first).select("id", "to", _distance("q", "v").alias("dist"), unseen), "graph-seen")
    best = Window.partitionBy("id").orderBy("dist", "to")
    next_ones = Window.partitionBy("id", "open").orderBy("dist", "to")
    while True:
        ranked = seen.withColumn("open", (F.row_number().over(best) <= beam) & ~F.col("done"))
        taken = ranked.withColumn("now", F.col("open") & (F.row_number().over(next_ones) <= wide))
        taken = stored(taken.select("id", "to", "dist", (F.col("done") | F.col("now")).alias("done"), "now"), "graph-beam")
        discard(seen)
        frontier = taken.filter("now").select("id", F.col("to").alias("node"))
        if frontier.first() is None:
            break
        met = frontier.join(edges.select("node", "to"), "node").select("id", "to").distinct().join(taken.select("id", "to"), ["id", "to"], "left_anti")
        new = met.join(nodes.select(F.col("id").alias("to"), "v"), "to").join(asked, "id").select("id", "to", _distance("q", "v").alias("dist"), unseen)
        seen = stored(taken.drop("now").unionByName(new), "graph-seen")
        discard(taken)
    discard(asked)
    answers = taken.filter(F.col("to") != F.col("id")) if skip_self else taken
    counts = taken.groupBy("id").agg(F.count(F.lit(1)).alias("compared"))
    found = answers.groupBy("id").agg(F.min(F.struct("dist", F.col("to").alias("nn_id"))).alias("m"))
    return found.join(counts, "id").select("id", "m.nn_id", "m.dist", "compared")
