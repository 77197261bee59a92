"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers, and equal ones are grouped with their multiplicity before anything
else, so that Lloyd's rounds run over the distinct vectors only, however many copies there are. A round
is one pass: each task assigns its vectors and returns, for each cluster, the weighted sum of every
component; those k x dim sums of a task are added up in a shuffle and divided in whole numbers. The
last assignment is joined back to the rows by the vector's 128-bit name. Vectors with many copies are
joined by broadcast, at most one in ten thousandth of the rows each, hence at most so many.

All arithmetic is exact: products in double where they are below 2^53, else in 64-bit integers; sums over
rows in decimals. What passes the driver is k x dim numbers per round.

Defined cases: a vector that is null, of another dimension than ``dim``, or with a null or non-finite
component takes no part and has no row in the result; one with a component of 2^27 or more after scaling is an
error, as its distances don't fit a long. Fewer kept vectors than k make as many centroids as there are. Equal
vectors may start several centroids; the smaller number takes them. Rows with one vec_id are returned one by one, those
with a null vec_id too, and as starting points null comes last, equal ids in the order of their vectors. A table without kept
vectors gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import join_by_counts, materialize
from .vectors import finite, quantised

_BOUND = 1 << 27
_SCHEMA = "vec_id long, cluster int, distance long, copies long, cluster_inertia long, inertia long, centroid_sha256 string"
_KEY = ["__k1", "__k2"]


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim).astype(np.int64)


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row, exactly; ties to the smaller number."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def weighted_sums(x: np.ndarray, n: np.ndarray, cluster: np.ndarray, total: np.ndarray) -> None:
    """Add to total (k x (1 + dim) Python integers) each cluster's weight and weighted component sums."""
    order = np.argsort(cluster, kind="stable")
    cluster, x, n = cluster[order], x[order], n[order]
    if (int(np.abs(x).max(initial=1)) + 1) * int(n.astype(object).sum()) >= 1 << 62:
        x, n = x.astype(object), n.astype(object)
    cut = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1])))
    total[cluster[cut]] += np.add.reduceat(np.column_stack([n, x * n[:, None]]), cut, axis=0).astype(object)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(cluster, -1) -> weight and (cluster, dim) -> weighted sum, of non-empty clusters."""
    sent = distinct.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        total = np.zeros((len(c), 1 + c.shape[1]), object)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), c.shape[1])
                weighted_sums(x, batch.column("n").to_numpy(), assign(x, c)[0], total)
        at = np.flatnonzero(total[:, 0] > 0)
        if len(at):
            cluster, dim = np.repeat(at, total.shape[1]), np.tile(np.arange(-1, c.shape[1]), len(at))
            held = pa.array([Decimal(int(s)) for s in total[at].ravel()], pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), held], names=["cluster", "dim", "s"])

    parts = distinct.select("v", "n").mapInArrow(run, "cluster int, dim int, s decimal(38,0)")
    return {(r["cluster"], r["dim"]): int(r["s"]) for r in parts.groupBy("cluster", "dim").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Each non-empty cluster's floor(sum / weight) by component; the others stay."""
    out = centroids.copy()
    for (c, dim), s in sums.items():
        if dim >= 0:
            out[c, dim] = s // sums[c, -1]
    return out


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    sent = distinct.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, d = assign(matrix(batch.column("v"), sent.value.shape[1]), sent.value)
                yield pa.record_batch([*(batch.column(c) for c in (*_KEY, "n")), pa.array(best.astype(np.int32)), pa.array(d)], names=[*_KEY, "n", "cluster", "distance"])

    return distinct.mapInArrow(run, "__k1 long, __k2 long, n long, cluster int, distance long")


def cluster(
    rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Per kept row: vec_id, cluster, distance (squared), copies (rows with that vector), cluster_inertia, inertia,
    centroid_sha256. The starting centroids are the k rows with least sha256 of ``seed:vec_id``."""
    spark = rows.sparkSession
    vec = F.col(vec_col)
    kept = rows.filter((F.size(vec) == dim) & finite(vec)).select(F.col(id_col).cast("long").alias("vec_id"), quantised(vec, scale, _BOUND).alias("v"))
    named = [F.xxhash64("v").alias("__k1"), F.xxhash64(F.lit("second"), "v").alias("__k2")]
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last()
    first = kept.orderBy(order, "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], _SCHEMA)
    centroids = np.array([r["v"] for r in first], np.int64)
    distinct = materialize(kept.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(*named, "v", "n"), "distinct-vectors", 10_000)
    for _ in range(rounds):
        centroids = moved(centroids, _sums(distinct, centroids))
    done = materialize(_assigned(distinct, centroids), "assigned-vectors", 10_000)
    spread = done.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("distance")).alias("s"), F.sum("n").alias("n")).collect()
    own = {r["cluster"]: int(r["s"]) for r in spread}
    total, n_rows = sum(own.values()), sum(r["n"] for r in spread)
    if total >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, total, sha[c]) for c, s in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = join_by_counts(kept.select("vec_id", *named), done, _KEY, "n", n_rows)
    return back.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", F.col("n").alias("copies"), "cluster_inertia", "inertia", "centroid_sha256")
