"""A backbone that is trained here: convolution filters from the principal components of image patches.

The filters of a layer are the leading eigenvectors of the covariance of small patches (with all their channels), taken over
every patch of all training images. Tasks add up the patches' first and second moments, a few hundred numbers per task, and
the driver decomposes one small matrix. A view's features are the mean strengths of all filters, and their largest, in the
cells of each layer's grid; larger filters belong to the coarser grids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .patchcore import Backbone, blocks_of, tile_views
from .raster import image_sizes, map_views, source_rectangle


def windows(view: np.ndarray, size: int) -> np.ndarray:
    """All patches of ``size`` pixels a side as rows (rows x columns x size*size*channels), edges repeated."""
    pad = size // 2
    a = np.pad(view, ((pad, size - 1 - pad), (pad, size - 1 - pad), (0, 0)), mode="edge")
    w = np.lib.stride_tricks.sliding_window_view(a, (size, size), axis=(0, 1))
    return w.reshape(*view.shape[:2], -1)


def moments(images: DataFrame, size: int, tile: int = 256) -> tuple[int, np.ndarray, np.ndarray]:
    """(patches, sums, sums of products) over all patches of the images."""

    def kernel(views: Iterator[tuple[dict, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, 0.0, 0.0
        for _, view in views:
            x = windows(view, size).reshape(-1, size * size * view.shape[2])
            n, first, second = n + len(x), first + x.sum(0), second + x.T @ x
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([first.tobytes()]), pa.array([second.tobytes()])], names=["n", "first", "second"])

    blocks = blocks_of(images)
    views = tile_views(image_sizes(blocks), tile, overlap=0)
    rows = map_views(blocks, source_rectangle(views), kernel, "n long, first binary, second binary").collect()  # a row per task
    if not rows:
        raise ValueError("no images to train on")
    first = sum(np.frombuffer(r["first"]) for r in rows)
    return sum(r["n"] for r in rows), first, sum(np.frombuffer(r["second"]) for r in rows).reshape(len(first), -1)


def filters_of(n: int, first: np.ndarray, second: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean patch, filters as columns), each scaled to unit variance over the patches; their signs are fixed."""
    mean = first / n
    value, vector = np.linalg.eigh(second / n - np.outer(mean, mean))
    order = np.argsort(-value)[:count]
    value, vector = np.maximum(value[order], 1e-9), vector[:, order]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    return mean, vector * np.where(sign == 0, 1, sign) / np.sqrt(value)


def train_backbone(images: DataFrame, grids: tuple[int, ...] = (4, 2), sizes: tuple[int, ...] = (3, 5), count: int = 8) -> Backbone:
    """A backbone with ``count`` filters per layer, trained on all patches of the images (blocks or pixels)."""
    blocks = blocks_of(images)
    layers = [(g, s, *filters_of(*moments(blocks, s), count)) for g, s in zip(grids, sizes, strict=True)]

    def extract(view: np.ndarray) -> list[np.ndarray]:
        out = []
        for grid, size, mean, filters in layers:
            strength = np.abs((windows(view, size) - mean) @ filters)
            h, w, k = strength.shape
            cells = np.full((grid, grid, 2 * k), np.nan)
            rows, cols = (np.arange(n) * grid // n for n in (h, w))
            for y in np.unique(rows):
                for x in np.unique(cols):
                    part = strength[rows == y][:, cols == x].reshape(-1, k)
                    cells[y, x] = np.concatenate([part.mean(0), part.max(0)])
            out.append(cells)
        return out

    extract.grids = grids
    return extract
