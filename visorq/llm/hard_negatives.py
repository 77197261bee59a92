"""Hard-negative mining by product quantisation with stored residual norms.

Every vector is cut into subspaces, and each part is written as the number of its nearest codebook entry and
the length of what is left, rounded up. Codebook entries are whole numbers, so a sum of table entries is an exact
inner product with the coded vector, and by the Cauchy-Schwarz inequality the true product lies within the sum
of (length of the anchor's part) x (length of the residual): no rounding can break the bound.

Anchors meet all rows in a grid: rows are dealt by a hash of the id into row blocks, anchors into anchor blocks, and
each pair of blocks is one group of a two-sided shuffle; nothing is broadcast but the codebooks. Inside a group
each anchor's lookup table scores all codes; what the bounds can't rule out is scored exactly in the order of
its upper bound until no row left can enter. A group returns at most ``positives`` or ``negatives`` rows for
each window, and a ranked window merges the groups. There are two passes: positives first, then, with their
scores known, the negatives of each window. The work is anchors x rows by definition, a few bytes per pair.

The codebooks are fitted on at most ``sample`` rows, by a hash of the id; all rows are coded, and the fit changes how
many rows are scored exactly, never the result.

Defined cases: rows with a null label, id or vector, or a null or non-finite component take no part; one with a
component of 2^23 or more after scaling is an error. Of rows that share a vec_id only the one of least (label,
vector) counts. Vectors of different lengths are compared as if the shorter had zeros behind. Ties go to the smaller
vec_id. An anchor without positives, or a positive whose window holds no row, gives no row; so does an empty table. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, shuffle_partitions
from .vectors import finite, quantised

_BOUND = 1 << 23
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Rows of a row block and anchors of an anchor block, at most about; and candidates that are scored exactly at a time.
ROWS, ANCHORS, CHUNK = 8192, 2048, 64
_CODED = "id long, label int, v binary, codes binary, left binary"


class Codebooks:
    """parts x entries x width whole numbers."""

    def __init__(self, sample: np.ndarray, parts: int, entries: int = 256, rounds: int = 8):
        n, dim = sample.shape
        self.parts = max(1, min(parts, dim))
        self.width = max(1, -(-dim // self.parts))
        x = self.cut(sample)
        rng = np.random.default_rng(7)
        start = np.sort(rng.permutation(n)[:entries])
        self.books = np.zeros((self.parts, max(1, len(start)), self.width), np.int64)
        for m in range(self.parts if n else 0):
            c = x[start, m].astype(float)
            for _ in range(rounds):
                near = self._near(x[:, m], c)
                many = np.bincount(near, minlength=len(c))
                total = np.stack([np.bincount(near, x[:, m, i], len(c)) for i in range(self.width)], axis=1)
                c = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], c)
            self.books[m] = np.rint(c)

    def cut(self, x: np.ndarray) -> np.ndarray:
        """rows x parts x width, with zeros behind."""
        out = np.zeros((len(x), self.parts * self.width), np.int64)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), self.parts, self.width)

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1) - 2.0 * (x.astype(float) @ c.T)).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each part, length of its residual rounded up)."""
        cut = self.cut(x)
        codes = np.stack([self._near(cut[:, m], self.books[m].astype(float)) for m in range(self.parts)], axis=1)
        return codes.astype(np.uint8), lengths(cut - self.books[np.arange(self.parts), codes])

    def tables(self, anchor: np.ndarray) -> np.ndarray:
        """parts x entries: the anchor's products with all codebook entries."""
        return (self.books * self.cut(anchor[None, :])[0][:, None, :]).sum(2)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the last axis, rounded up to a whole number that is surely no smaller."""
    squared = (x.astype(np.int64) ** 2).sum(-1)
    return np.where(squared == 0, 0, np.sqrt(squared.astype(float)).astype(np.int64) + 1)


class Block:
    """Coded rows of a block, by label; of equal ids the least (label, vector)."""

    def __init__(self, table: pa.Table, books: Codebooks):
        def rows(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(table.num_rows, -1)

        ids, labels, v = table["id"].to_numpy(), table["label"].to_numpy(), rows("v", np.int32)
        order = np.argsort(ids, kind="stable")
        if (ids[order][1:] == ids[order][:-1]).any():
            order = np.lexsort((*v.T[::-1], labels, ids))
            order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]
        order = order[np.argsort(labels[order], kind="stable")]
        self.books, self.ids, self.labels = books, ids[order], labels[order]
        most = int(np.abs(v).max(initial=0))
        self.v = v[order].astype(float if v.shape[1] * most * most < 1 << 53 else np.int64)
        self.at = rows("codes", np.uint8)[order].astype(np.int64) + np.arange(books.parts) * books.books.shape[1]
        self.left = rows("left", np.uint32)[order].astype(float)

    def label_span(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def bounds(self, anchor: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) that each row's product with the anchor can be."""
        score = self.books.tables(anchor).ravel()[self.at[rows]].sum(1)
        slack = np.ceil(self.left[rows] @ lengths(self.books.cut(anchor[None, :]))[0].astype(float) * (1 + 1e-12)).astype(np.int64)
        return score - slack, score + slack

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.v[at] @ anchor.astype(self.v.dtype)).astype(np.int64)


def first_of(ids: np.ndarray, low: np.ndarray, high: np.ndarray, exact, most: int, least: int | None = None, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores): the ``most`` rows of highest score between ``least`` and ``top``, ties by id. low, high: bounds of
    the scores; exact: scores of given rows.

    Rows that no bound rules out are scored in the order of their upper bounds, until enough are found that no row
    left can pass or tie."""
    may = np.ones(len(ids), bool)
    if least is not None:
        may = (high >= least) & (low <= top)
        sure = low[(low >= least) & (high <= top)]
    else:
        sure = low
    if len(sure) >= most:
        may &= high >= np.partition(sure, len(sure) - most)[len(sure) - most]
    rows = np.flatnonzero(may)
    rows = rows[np.argsort(-high[rows], kind="stable")]
    at, got, i, step = rows[:0], np.zeros(0, np.int64), 0, CHUNK
    while i < len(rows):
        if len(got) >= most and got[most - 1] > high[rows[i]]:
            break
        new = rows[i : i + step]
        s = exact(new)
        good = np.ones(len(new), bool) if least is None else (s >= least) & (s <= top)
        at, got = np.concatenate([at, new[good]]), np.concatenate([got, s[good]])
        order = np.lexsort((ids[at], -got))[:most]
        at, got = at[order], got[order]
        i, step = i + step, step * 2
    return at, got


def _positives(block: Block, anchors: Block, most: int) -> Iterator[tuple]:
    for i, (anchor_id, label) in enumerate(zip(anchors.ids.tolist(), anchors.labels.tolist(), strict=True)):
        a, b = block.label_span(label)
        if b == a:
            continue
        vec = anchors.v[i].astype(np.int64)
        low, high = block.bounds(vec, slice(a, b))
        own = a + np.flatnonzero(block.ids[a:b] != anchor_id)
        at, score = first_of(block.ids[own], low[own - a], high[own - a], lambda r, own=own, vec=vec: block.exact(vec, own[r]), most)
        yield from ((anchor_id, x, s) for x, s in zip(block.ids[own[at]].tolist(), score.tolist(), strict=True))


def _negatives(block: Block, anchors: Block, wanted: dict[int, list[tuple[int, int]]], most: int, low_pct: int, high_pct: int) -> Iterator[tuple]:
    for i, (anchor_id, label) in enumerate(zip(anchors.ids.tolist(), anchors.labels.tolist(), strict=True)):
        windows = [(p, s, -(-low_pct * s // 100), high_pct * s // 100) for p, s in wanted.get(anchor_id, ())]
        windows = [w for w in windows if w[2] <= w[3]]
        if not windows:
            continue
        vec = anchors.v[i].astype(np.int64)
        low, high = block.bounds(vec, slice(None))
        a, b = block.label_span(label)
        other = np.ones(len(block.ids), bool)
        other[a:b] = False
        # one set of candidates for all windows; what is scored exactly for one is known to the next
        own = np.flatnonzero(other & (high >= min(w[2] for w in windows)) & (low <= max(w[3] for w in windows)))
        low, high = low[own], high[own]

        def exact(rows: np.ndarray, own=own, vec=vec, low=low, high=high) -> np.ndarray:
            new = rows[low[rows] != high[rows]]
            low[new] = high[new] = block.exact(vec, own[new])
            return low[rows]

        for p, s, least, top in windows:
            at, score = first_of(block.ids[own], low, high, exact, most, least, top)
            yield from ((anchor_id, p, s, x, y) for x, y in zip(block.ids[own[at]].tolist(), score.tolist(), strict=True))


def _grid(coded: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, run, schema: str) -> DataFrame:
    """``run`` over every pair of a row block and an anchor block."""
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = max(shuffle_partitions(coded.sparkSession), min(3 * row_blocks * anchor_blocks, 10_000))
    left = coded.withColumn("rb", place(row_blocks)).withColumn("ab", every(anchor_blocks)).repartition(parts, "rb", "ab")
    right = anchors.withColumn("ab", place(anchor_blocks)).withColumn("rb", every(row_blocks)).repartition(parts, "rb", "ab")
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(run, schema)


def hard_negatives(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, scale: int = 256, shift_every: int = 7, labels: int = 10, parts: int = 32,
    sample: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", row_block: int = ROWS, anchor_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the anchors (ids divisible by ``every``).

    Ids divisible by ``shift_every`` get the next of ``labels`` labels first. parts: subspaces of a code; sample: rows on which
    the codebooks are fitted, at most."""
    spark = rows.sparkSession
    vec, key, label = F.col(vec_col), F.col(id_col).cast("long"), F.col(label_col).cast("int")
    taken = rows.filter(finite(vec) & label.isNotNull() & key.isNotNull()).select(
        key.alias("id"), F.when(key % shift_every == 0, (label + 1) % labels).otherwise(label).alias("label"), quantised(vec, scale, _BOUND).alias("v"))
    size = taken.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.sum((F.col("id") % every == 0).cast("long")).alias("anchors")).first()
    n, dim = size["n"], max(1, size["dim"] or 0)
    if not n or not size["anchors"]:
        return spark.createDataFrame([], _OUT)
    fit = taken if n <= sample else taken.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 31)) < int((1 << 31) * min(1.0, sample / n)))
    drawn = fit.select("id", "v").limit(2 * sample).toArrow().sort_by("id")
    sent = spark.sparkContext.broadcast(Codebooks(_dense(drawn["v"], dim), parts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _dense(batch.column("v"), dim)
                codes, left = sent.value.encode(x)
                packed = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x.astype(np.int32), codes, left.astype(np.uint32))]
                yield pa.record_batch([batch.column("id"), batch.column("label"), *packed], names=["id", "label", "v", "codes", "left"])

    coded = materialize(taken.mapInArrow(encode, _CODED), "coded-vectors", 10_000)
    anchors = coded.filter(F.col("id") % every == 0)
    row_blocks = max(-(-n // row_block), min(shuffle_partitions(spark), -(-n * 8 // row_block)))
    anchor_blocks = -(-size["anchors"] // anchor_block)

    def find_positives(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(_positives(Block(mine, sent.value), Block(asked, sent.value), positives)) if mine.num_rows and asked.num_rows else []
        return pa.table({c: pa.array([r[i] for r in found], pa.int64()) for i, c in enumerate(("anchor_id", "id", "score"))})

    near = _grid(coded, anchors, row_blocks, anchor_blocks, find_positives, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives)
    wanted = best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("r", F.col("id").alias("p"), "score"))).alias("wanted"))

    def find_negatives(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if mine.num_rows and asked.num_rows:
            by_anchor = {i: [(w["p"], w["score"]) for w in ws] for i, ws in zip(asked["id"].to_pylist(), asked["wanted"].to_pylist(), strict=True)}
            found = list(_negatives(Block(mine, sent.value), Block(asked, sent.value), by_anchor, negatives, low_pct, high_pct))
        return pa.table({c: pa.array([r[i] for r in found], pa.int64()) for i, c in enumerate(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))})

    asked = materialize(anchors.join(wanted, "id"), "positives", 10_000)
    found = _grid(coded, asked, row_blocks, anchor_blocks, find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _dense(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers, shorter vectors with zeros behind."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = flat
    return out
