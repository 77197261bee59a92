"""Exact nearest neighbours as a grid of blocks: every query block meets every bank block of its lot in one group of a
two-sided shuffle. Nothing goes through the driver or into a broadcast but the lots' sizes.

A lot is a set of groups (ROIs, index lists) that are searched apart from all others. Its bank is cut into blocks of at most
``BLOCK_BYTES`` by a hash of the id, its queries too, so one hot group is spread over as many pairs of blocks as its size
asks for. A pair returns at most k rows per query; with several bank blocks a ranked window merges them.

What is shuffled is the bank once per query block and the queries once per bank block. The grid is therefore as coarse as
blocks and cores allow, and as square: about the root of ``WAVES`` pairs per core on each side, so the shuffle grows with
the rows until blocks are full. Vectors whose components are all floats are shipped as floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors in a block of the bank, or of the queries.
BLOCK_BYTES = 64_000_000
#: Pairs of blocks for each core, and comparisons that are worth a pair of their own.
WAVES, WORTH = 4, 1_000_000
#: Queries and bank rows in one matrix product; candidates whose distances are taken at once; candidates that are held.
SLICE, TILE, GATHER, HELD = 256, 2048, 65_536, 1_000_000
#: Lots of a search by group, for each shuffle partition; partitions of a grid at most.
LOTS, PARTS = 4, 10_000
SCHEMA = "g string, id long, nn_id long, dist double, rank int"


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of its numbers."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def nearest(q: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, bank id, distance) of the k nearest bank rows of each query, by distance and then id. own: the queries'
    ids, which ``skip_self`` leaves out of the bank.

    A matrix product finds what can be among the nearest; distances are then taken from the differences."""
    own_sq, bank_sq = (q * q).sum(1), (b * b).sum(1)
    approx = (q * -2.0) @ b.T
    approx += own_sq[:, None]
    approx += bank_sq
    if skip_self:
        approx[ids[None, :] == own[:, None]] = np.inf
    k = min(k, len(b))
    # far above the product's rounding
    edge = (approx.min(1) if k == 1 else np.partition(approx, k - 1, axis=1)[:, k - 1]) + 1e-9 * (1 + own_sq + bank_sq.max())
    may = approx <= edge[:, None]
    if skip_self:
        may &= approx < np.inf
    row, at = np.nonzero(may)
    dist = np.sqrt(((b[at] - q[row]) ** 2).sum(1))
    order = np.lexsort((ids[at], dist, row))
    row, at, dist = row[order], at[order], dist[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], ids[at[first]], dist[first]


def _ranked(q: np.ndarray, b: np.ndarray, ids: np.ndarray, row: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates (row, at) of each query, by distance from the differences and then id."""
    dist = np.empty(len(row))
    for i in range(0, len(row), GATHER):
        x, y = row[i : i + GATHER], at[i : i + GATHER]
        dist[i : i + GATHER] = np.sqrt(((b[y].astype(float) - q[x].astype(float)) ** 2).sum(1))
    order = np.lexsort((ids[at], dist, row))
    row, at, dist = row[order], at[order], dist[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], at[first], dist[first]


def _few_copies(b: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The bank without those of equal vectors that can't be among the nearest: ``most`` with the least ids stay. Rows are in
    the order of their ids."""
    if (ids[1:] == ids[:-1]).any():
        return b, ids
    b = np.ascontiguousarray(b)
    _, same, many = np.unique(b.view(f"V{b.dtype.itemsize * b.shape[1]}").ravel(), return_inverse=True, return_counts=True)
    if many.max() <= most:
        return b, ids
    order = np.argsort(same, kind="stable")
    keep = np.sort(order[np.arange(len(b)) - np.searchsorted(same[order], same[order]) < most])
    return b[keep], ids[keep]


def _nearest_tiled(q: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, skip_self: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, query, bank id, distance), as ``nearest``, for slices of the queries, with memory for a tile beside the blocks.

    Products of singles, around the bank's mean, find what can be among the nearest: each tile keeps what is not above the k-th
    least so far by more than twice the rounding. Where singles leave too many, the tile is taken in doubles."""
    order = np.argsort(ids, kind="stable")
    b, ids = _few_copies(b[order], ids[order], k + 1)
    k, dim, mean = min(k, len(b)), b.shape[1], b.mean(0, dtype=float)
    # a column more makes the product |b|^2 - 2 q.b
    wide, side = np.empty((len(b), dim + 1), np.float32), np.empty(len(b))
    for i in range(0, len(b), TILE):
        part = b[i : i + TILE] - mean
        side[i : i + TILE] = (part * part).sum(1)
        wide[i : i + TILE, :dim], wide[i : i + TILE, dim] = part, side[i : i + TILE]
    largest = side.max()

    def candidates(q: np.ndarray, own: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """(query, place in the bank) of what can be among the nearest; None where singles leave too many."""
        part = q - mean
        norm = (part * part).sum(1)
        # rounding: some dim + 8 steps of the kind's last place on terms of |q|^2 + 2 |b|^2 at most, taken several times over
        slack = (norm + largest) * ((dim + 8) * (2e-15 if exact else 1e-6))
        if exact:
            ask = -2 * part
        elif norm.max() + largest > 1e30:
            return None
        else:
            ask = np.concatenate([-2 * part, np.ones((len(part), 1))], axis=1).astype(np.float32)
        lo, hi = (np.searchsorted(ids, own, s) for s in ("left", "right"))
        best, rows, ats, held = np.full((len(part), k), np.inf), [], [], 0
        for t in range(0, len(b), TILE):
            end = min(t + TILE, len(b))
            out = ask @ (b[t:end] - mean).T + side[t:end] if exact else ask @ wide[t:end].T
            if skip_self:
                for r in np.flatnonzero((lo < end) & (hi > t) & (hi > lo)).tolist():
                    out[r, max(0, lo[r] - t) : hi[r] - t] = np.inf
            edge = best[:, -1]
            if k <= end - t and not np.isfinite(edge).all():
                edge = np.minimum(edge, out.min(1) if k == 1 else np.partition(out, k - 1, axis=1)[:, k - 1])
            row, at = np.divmod(np.flatnonzero(out <= (edge + slack).astype(out.dtype)[:, None]), end - t)
            value = out[row, at]
            if skip_self:
                row, at, value = (x[value < np.inf] for x in (row, at, value))
            if not len(row):
                continue
            rows.append(row)
            ats.append(at + t)
            held += len(row)
            if held > HELD:
                if not exact:
                    return None
                row_, at_, _ = _ranked(q, b, ids, np.concatenate(rows), np.concatenate(ats), k)
                rows, ats, held = [row_], [at_], len(row_)
            every, values = np.concatenate([np.repeat(np.arange(len(part)), k), row]), np.concatenate([best.ravel(), value])
            by = np.lexsort((values, every))
            first = np.arange(len(by)) - np.searchsorted(every[by], every[by]) < k
            best = values[by][first].reshape(len(part), k)
        return (np.concatenate(rows), np.concatenate(ats)) if rows else (np.zeros(0, int), np.zeros(0, int))

    for x in range(0, len(q), SLICE):
        mine = q[x : x + SLICE], own[x : x + SLICE]
        row, at = candidates(*mine, False) or candidates(*mine, True)
        row, at, dist = _ranked(mine[0], b, ids, row, at, k)
        yield x, row, ids[at], dist


def _spans(g: pa.ChunkedArray) -> dict[str | None, tuple[int, int]]:
    """Where each group of a sorted column begins and ends."""
    if not len(g):
        return {}
    g = g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g
    codes = g.dictionary_encode(null_encoding="encode").indices.to_numpy()
    cut = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return {g[a].as_py(): (a, b) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=True)}


def _search_pair(bank: pa.Table, queries: pa.Table, k: int, skip_self: bool) -> pa.Table:
    out = []
    if bank.num_rows and queries.num_rows:
        bank, queries = (x if pc.count_distinct(x["g"], mode="all").as_py() == 1 else x.sort_by("g") for x in (bank, queries))
        (b, ids), (q, own) = (matrix(bank["v"]), bank["b"].to_numpy()), (matrix(queries["v"]), queries["id"].to_numpy())
        held = _spans(bank["g"])
        for g, (x, y) in _spans(queries["g"]).items():
            s, e = held.get(g, (0, 0))
            if e == s:
                continue
            small = (y - x) * (e - s) <= SLICE * TILE
            found = [(0, *nearest(q[x:y].astype(float), own[x:y], b[s:e].astype(float), ids[s:e], k, skip_self))] if small else _nearest_tiled(q[x:y], own[x:y], b[s:e], ids[s:e], k, skip_self)
            for i, row, nn, d in found:
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                out.append((pa.array([g] * len(row), pa.string()), own[x + i + row], nn, d, rank.astype(np.int32)))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
    cols = [pa.concat_arrays([pa.array(o[c], kinds[c]) for o in out]) if out else pa.array([], kinds[c]) for c in range(5)]
    return pa.table(cols, names=["g", "id", "nn_id", "dist", "rank"])


def _shape(bank: int, queries: int, width: int, block: int, pairs: int) -> tuple[int, int]:
    """Blocks of the bank and of the queries: as few as their size allows, then more of the side whose cut ships fewer rows for
    each pair gained, until there are ``pairs`` pairs or they are too small to be worth one."""
    nb, nq = -(-bank * width // block), -(-queries * width // block)
    most = min(pairs, -(-bank * queries // WORTH))
    while nb * nq < most:
        nb, nq = (nb, nq + 1) if bank * nq <= queries * nb else (nb + 1, nq)
    return nb, nq


def grid_search(queries: DataFrame, bank: DataFrame, k: int = 1, skip_self: bool = False, lot: Column | None = None, lots: int = 1, block_bytes: int | None = None) -> DataFrame:
    """(g, id, nn_id, dist, rank): the k nearest bank rows (g, b, v) of each query's (g, id, v) group, by distance and id.

    block_bytes: of a block's vectors, ``BLOCK_BYTES`` by default. lot: a whole number below ``lots`` that depends on g, for both sides; by default a hash of g, or one lot where all
    rows have the same group."""
    spark = queries.sparkSession
    lot = F.lit(0) if lots == 1 else F.pmod(F.xxhash64("g"), F.lit(lots)).cast("int") if lot is None else lot
    lossless = F.col("v").eqNullSafe(F.col("v").cast("array<float>").cast("array<double>"))
    side = lambda x, n: x.select(lot.alias("lot"), F.lit(n).alias("side"), F.size("v").alias("dim"), lossless.alias("float"))
    count = lambda n: F.sum((F.col("side") == n).cast("long"))
    sizes = side(bank, 0).unionAll(side(queries, 1)).groupBy("lot").agg(count(0).alias("b"), count(1).alias("q"), F.max("dim").alias("dim"), F.bool_and("float").alias("float")).collect()
    both = [(r["lot"], r["b"], r["q"], 8 * max(1, r["dim"])) for r in sizes if r["b"] and r["q"]]
    if not both:
        return spark.createDataFrame([], SCHEMA)
    kind = "array<float>" if all(r["float"] for r in sizes) else "array<double>"
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    whole = sum(b * q for _, b, q, _ in both)
    shapes = [(at, *_shape(b, q, width, block_bytes or BLOCK_BYTES, -(-b * q * WAVES * spark.sparkContext.defaultParallelism // whole))) for at, b, q, width in both]
    pairs, deep = sum(b * q for _, b, q in shapes), max(b for _, b, _ in shapes)
    if len(shapes) == 1:
        shaped = lambda x: x.withColumns({"lot": lot, "nb": F.lit(shapes[0][1]), "nq": F.lit(shapes[0][2])}).filter(F.col("lot") == shapes[0][0])
    else:
        table = F.broadcast(spark.createDataFrame(shapes, "lot int, nb int, nq int"))  # a row per lot
        shaped = lambda x: x.withColumn("lot", lot).join(table, "lot")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = 1 if pairs == 1 else min(max(cores, 3 * pairs), PARTS)
    left = shaped(bank).withColumn("bb", place("b", "nb")).withColumn("qb", every("nq")).select("lot", "bb", "qb", "g", "b", F.col("v").cast(kind).alias("v")).repartition(parts, "lot", "bb", "qb")
    right = shaped(queries).withColumn("qb", place("id", "nq")).withColumn("bb", every("nb")).select("lot", "bb", "qb", "g", "id", F.col("v").cast(kind).alias("v")).repartition(parts, "lot", "bb", "qb")
    key = ("lot", "bb", "qb")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda x, y: _search_pair(x, y, k, skip_self), SCHEMA)
    if deep == 1:
        return found
    order = Window.partitionBy("g", "id").orderBy("dist", "nn_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
