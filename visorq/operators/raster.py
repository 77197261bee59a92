"""Images as packed blocks: a row holds a rectangle of pixels as one binary, and kernels work on whole arrays.

A block is at most ``BLOCK`` pixels a side. What looks at a rectangle of an image (a tile, a ROI, a scaled image) gets it in
pieces: each block that the rectangle touches is cut to the part it needs, edges for the interpolation included, before
anything is shuffled, and one task puts a rectangle's pieces together. No task holds more than a rectangle and a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import sorted_runs
from .imaging import MEAN, STD

#: Pixels of a block a side, at most.
BLOCK = 512
_BLOCKS = "image_id long, by int, bx int, h int, w int, c int, data binary"
_GEOMETRY = ("scale", "x", "y", "w", "h", "img_w", "img_h", "src_x", "src_y", "src_w", "src_h")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key side by side in one of the session's shuffle partitions. Their number is given, as few bytes can be
    much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """The rows of equal keys of a sorted stream, as dicts; one run is held at a time, and a batch."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return (list(run) for _, run in groupby(rows, lambda r: [r[k] for k in keys]))


def _batched(rows: Iterator[tuple], schema: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes: a batch of its own for every small row would cost more than the row."""
    names, kinds = zip(*(x.rsplit(" ", 1) for x in schema.split(", ")), strict=True)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield pa.record_batch([pa.array(c, _KINDS[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, _KINDS[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))


def pack(pixels: DataFrame, side: int = BLOCK) -> DataFrame:
    """image_id, by, bx, h, w, c, data (doubles, row by row, channels last) of pixels (image_id, row, col, ch, v). Pixels that
    are missing inside a block are 0; of several at one place one stays."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in sorted_runs(batches, "image_id", "by", "bx"):
            by, bx = t["by"][0].as_py(), t["bx"][0].as_py()
            y, x, ch = t["row"].to_numpy() - by * side, t["col"].to_numpy() - bx * side, t["ch"].to_numpy()
            out = np.zeros((y.max() + 1, x.max() + 1, ch.max() + 1))
            out[y, x, ch] = t["v"].to_numpy()
            yield t["image_id"][0].as_py(), by, bx, *out.shape, out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(blocks(batches), _BLOCKS)

    placed = pixels.select(F.col("image_id").cast("long").alias("image_id"), F.expr(f"int(row div {side})").alias("by"), F.expr(f"int(col div {side})").alias("bx"), F.col("row").cast("int"), F.col("col").cast("int"), F.col("ch").cast("int"), F.col("v").cast("double"))
    return _dealt(placed, "image_id", "by", "bx").mapInArrow(run, _BLOCKS)


def unpack(blocks: DataFrame, value: str = "v", side: int = BLOCK) -> DataFrame:
    """image_id, row, col, ch and the value of each pixel of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.arange(r["h"] * r["w"] * r["c"])
                place = n // r["c"]
                cols = (np.full(len(n), r["image_id"]), place // r["w"] + r["by"] * side, place % r["w"] + r["bx"] * side, n % r["c"], np.frombuffer(r["data"]))
                yield pa.record_batch([pa.array(x.astype(k)) for x, k in zip(cols, ("i8", "i4", "i4", "i4", "f8"), strict=True)], names=["image_id", "row", "col", "ch", value])

    return blocks.mapInArrow(run, f"image_id long, row int, col int, ch int, {value} double")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


def image_sizes(images: DataFrame, side: int = BLOCK) -> DataFrame:
    """image_id, w, h of blocks or of a long pixel table."""
    if "data" in images.columns:
        return images.groupBy("image_id").agg(F.max(F.col("bx") * side + F.col("w")).alias("w"), F.max(F.col("by") * side + F.col("h")).alias("h"))
    return images.groupBy("image_id").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))


def source_rectangle(views: DataFrame) -> DataFrame:
    """Adds src_x, src_y, src_w, src_h: what an image's own pixels a view needs, its edges for the interpolation included.
    views: scale, x, y, w, h on the scaled image, img_w and img_h."""

    def first(at: Column, n: str) -> Column:
        place = (at + 0.5) / F.col("scale") - 0.5
        return F.floor(F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, place))).cast("int")

    out = views
    for at, size, n in (("x", "w", "img_w"), ("y", "h", "img_h")):
        low = first(F.col(at), n)
        high = F.least(first(F.col(at) + F.col(size) - 1, n) + F.when(F.col("scale") == 1.0, 0).otherwise(1), F.col(n) - 1)
        out = out.withColumns({f"src_{at}": low, f"src_{size}": high - low + 1})
    return out


@lru_cache(4096)
def taps(first: int, n_out: int, n_in: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, weight of high) of the output cells first .. first + n_out - 1: half-pixel centres, clamped."""
    s = np.clip((np.arange(first, first + n_out) + 0.5) * step - 0.5, 0, n_in - 1)
    low = np.floor(s).astype(np.int64)
    return low, np.minimum(low + 1, n_in - 1), s - low


def resample(a: np.ndarray, rows: tuple, cols: tuple) -> np.ndarray:
    """Bilinear: an array of rows x columns (x channels) by the taps of both axes."""
    wide = (slice(None), None) if a.ndim == 2 else (slice(None), None, None)
    low, high, w = rows
    a = a[low] * (1 - w)[wide] + a[high] * w[wide]
    low, high, w = cols
    w = w[None, :] if a.ndim == 2 else w[None, :, None]
    return a[:, low] * (1 - w) + a[:, high] * w


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return a if a.shape[:2] == (h, w) else resample(a, taps(0, h, a.shape[0], a.shape[0] / h), taps(0, w, a.shape[1], a.shape[1] / w))


def map_views(blocks: DataFrame, views: DataFrame, kernel, schema: str, side: int = BLOCK) -> DataFrame:
    """``kernel`` over the views of a task, an iterator of (view, raster); it yields record batches of ``schema``.

    views: image_id, view, tag and the geometry of ``source_rectangle``; view is a dict of them; raster is the view's pixels
    (h x w x channels), brought to its scale."""
    grid = lambda at, n: F.explode(F.sequence(F.expr(f"int({at} div {side})"), F.expr(f"int(({at} + {n} - 1) div {side})")))
    asked = views.select("image_id", "view", "tag", *[F.col(c).alias(f"v_{c}") for c in _GEOMETRY]).withColumn("by", grid("v_src_y", "v_src_h")).withColumn("bx", grid("v_src_x", "v_src_w"))
    carried = ["image_id", "view", "tag", *[f"v_{c}" for c in _GEOMETRY]]
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, parts = [], []
            geo = {c: batch.column(c).to_pylist() for c in ("by", "bx", "h", "w", "c", "v_src_x", "v_src_y", "v_src_w", "v_src_h")}
            data = batch.column("data")
            for i in range(batch.num_rows):
                by, bx, h, w, c, sx, sy, sw, sh = (geo[k][i] for k in geo)
                y0, x0 = by * side, bx * side
                top, bottom, left, right = max(sy, y0), min(sy + sh, y0 + h), max(sx, x0), min(sx + sw, x0 + w)
                if bottom > top and right > left:
                    a = np.frombuffer(data[i].as_buffer()).reshape(h, w, c)[top - y0 : bottom - y0, left - x0 : right - x0]
                    keep.append(i)
                    parts.append((top - sy, left - sx, *a.shape, a.tobytes()))
            cols = [pa.array([p[k] for p in parts], pa.int32()) for k in range(5)] + [pa.array([p[5] for p in parts], pa.binary())]
            yield pa.record_batch([*(batch.column(k).take(pa.array(keep, pa.int64())) for k in carried), *cols], names=[*carried, "p_y", "p_x", "p_h", "p_w", "p_c", "part"])

    def rasters(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
        for rows in _runs(batches, "image_id", "view"):
            v = {k.removeprefix("v_"): rows[0][k] for k in carried}
            src = np.zeros((v["src_h"], v["src_w"], max(r["p_c"] for r in rows)))
            for r in rows:
                src[r["p_y"] : r["p_y"] + r["p_h"], r["p_x"] : r["p_x"] + r["p_w"], : r["p_c"]] = np.frombuffer(r["part"]).reshape(r["p_h"], r["p_w"], r["p_c"])
            if v["scale"] != 1.0:
                axis = lambda at, size, n, first: _within(taps(at, size, n, 1 / v["scale"]), first)  # noqa: B023, E731
                src = resample(src, axis(v["y"], v["h"], v["img_h"], v["src_y"]), axis(v["x"], v["w"], v["img_w"], v["src_x"]))
            yield v, src

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kernel(rasters(batches))

    ahead = ", ".join(f"{c} {kinds[c]}" for c in carried)
    pieces = blocks.join(asked, ["image_id", "by", "bx"]).mapInArrow(cut, f"{ahead}, p_y int, p_x int, p_h int, p_w int, p_c int, part binary")
    return _dealt(pieces, "image_id", "view").mapInArrow(build, schema)


def model_inputs(blocks: DataFrame, size: int, side: int = BLOCK) -> DataFrame:
    """image_id, shape (3, size, size) and data in that order: each image resized, blue-green-red turned to red-green-blue,
    over 255 and standardised. An image is read and scaled in one task; one without three channels is an error."""
    if size <= 0:
        raise ValueError("inputs need a positive size")
    sizes = image_sizes(blocks, side)
    whole = sizes.select("image_id", F.lit(0).alias("view"), F.lit(None).cast("string").alias("tag"), F.lit(1.0).alias("scale"), F.lit(0).alias("x"), F.lit(0).alias("y"),
                         "w", "h", F.col("w").alias("img_w"), F.col("h").alias("img_h"))
    mean, std = np.array(MEAN)[:, None, None], np.array(STD)[:, None, None]
    # a batch of some 32 MB
    most = max(1, 4_000_000 // (3 * size * size))

    def kernel(images: Iterator[tuple[dict, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        while held := list(islice(images, most)):
            data = []
            for view, pixels in held:
                if pixels.shape[2] != 3:
                    raise ValueError(f"image {view['image_id']} has {pixels.shape[2]} channels, not 3")
                data.append(((resized(pixels, size, size)[:, :, ::-1].transpose(2, 0, 1) / 255 - mean) / std).ravel())
            n = len(held)
            shapes = pa.array([[3, size, size]] * n, pa.list_(pa.int32()))
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * (3 * size * size))
            yield pa.record_batch([pa.array([v["image_id"] for v, _ in held], pa.int64()), shapes, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(data)))], names=["image_id", "shape", "data"])

    return map_views(blocks, source_rectangle(whole), kernel, "image_id long, shape array<int>, data array<double>", side)


def _within(axis: tuple, first: int) -> tuple:
    """Taps that count from ``first``."""
    low, high, w = axis
    return low - first, high - first, w


def view_scores(scored: DataFrame, views: DataFrame, grids: tuple[int, ...], maps: bool = False, side: int = BLOCK) -> DataFrame:
    """Patch distances (image_id, view, layer_idx, patch_row, patch_col, dist) as scores of views.

    Each layer's grid is brought to the view's size, the largest layer counts for each pixel, with floor 0, and the view is
    brought to the size of its place in the image. Returns image_id, view, tag and score, the view's largest; with
    ``maps`` the pieces image_id, by, bx, p_y, p_x, h, w, data of the map, cut at blocks."""
    places = views.select("image_id", "view", "tag", "w", "h", "to_x", "to_y", "to_w", "to_h")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in sorted_runs(batches, "image_id", "view"):
            v = t.slice(0, 1).to_pylist()[0]
            layer, row, col, dist = (t[k].to_numpy() for k in ("layer_idx", "patch_row", "patch_col", "dist"))
            best = np.zeros((v["h"], v["w"]))
            for i, side_of in enumerate(grids):
                own = layer == i
                if own.any():
                    cells = np.zeros((side_of, side_of))
                    cells[row[own], col[own]] = dist[own]
                    np.maximum(best, resized(cells, v["h"], v["w"]), out=best)
            best = resized(best, v["to_h"], v["to_w"])
            if maps:
                yield from _cut_map(v, best, side)
            else:
                yield v["image_id"], v["view"], v["tag"], float(best.max())

    schema = _MAP if maps else "image_id long, view int, tag string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(found(batches), schema)

    return _dealt(scored.join(places, ["image_id", "view"]), "image_id", "view").mapInArrow(score, schema)


_MAP = "image_id long, by int, bx int, p_y int, p_x int, h int, w int, data binary"


def _cut_map(v: dict, a: np.ndarray, side: int) -> Iterator[tuple]:
    y, x = v["to_y"], v["to_x"]
    for by in range(y // side, (y + a.shape[0] - 1) // side + 1):
        for bx in range(x // side, (x + a.shape[1] - 1) // side + 1):
            top, left = max(y, by * side), max(x, bx * side)
            part = a[top - y : min(y + a.shape[0], (by + 1) * side) - y, left - x : min(x + a.shape[1], (bx + 1) * side) - x]
            yield v["image_id"], by, bx, top - by * side, left - bx * side, *part.shape, part.tobytes()


def fuse(pieces: DataFrame) -> DataFrame:
    """Blocks (as ``pack``'s, one channel) of a map whose pieces overlap: the largest value of each pixel counts."""

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _runs(batches, "image_id", "by", "bx"):
            out = np.zeros((max(r["p_y"] + r["h"] for r in rows), max(r["p_x"] + r["w"] for r in rows)))
            for r in rows:
                at = out[r["p_y"] : r["p_y"] + r["h"], r["p_x"] : r["p_x"] + r["w"]]
                np.maximum(at, np.frombuffer(r["data"]).reshape(r["h"], r["w"]), out=at)
            yield rows[0]["image_id"], rows[0]["by"], rows[0]["bx"], *out.shape, 1, out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(fused(batches), _BLOCKS)

    return _dealt(pieces, "image_id", "by", "bx").mapInArrow(run, _BLOCKS)
