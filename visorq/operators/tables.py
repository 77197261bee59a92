"""Processors as table functions, callable from SQL on any table that has their columns.

``visorq_nms(TABLE(det) PARTITION BY frame_id, label ORDER BY confidence DESC, det_id, iou => 0.45)`` returns the rows that
greedy suppression keeps, with all their columns. ``visorq_decode(TABLE(cells), classes => 3, version => 'v8')`` returns
the boxes of a head's cells. Both say at analysis which columns they return and refuse tables that lack what they
read. A partition of the first streams by: only the boxes kept so far are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _columns(table: AnalyzeArgument, needed: tuple[str, ...]) -> T.StructType:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    missing = [c for c in needed if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")
    return table.dataType


@udtf
class Nms:
    """Greedy suppression of a partition's rows in their order."""

    def __init__(self):
        self.kept = np.zeros((16, 4))
        self.n = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, iou: AnalyzeArgument = None, **other: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=_columns(table, ("cx", "cy", "w", "h")))

    def eval(self, table: Row, iou: float = 0.45) -> Iterator[tuple]:
        x, y, w, h = table["cx"], table["cy"], table["w"], table["h"]
        x1, y1, x2, y2 = x - w / 2, y - h / 2, x + w / 2, y + h / 2
        k = self.kept[: self.n]
        inter = np.maximum(0.0, np.minimum(k[:, 2], x2) - np.maximum(k[:, 0], x1)) * np.maximum(0.0, np.minimum(k[:, 3], y2) - np.maximum(k[:, 1], y1))
        union = (x2 - x1) * (y2 - y1) + (k[:, 2] - k[:, 0]) * (k[:, 3] - k[:, 1]) - inter + 1e-6
        if (inter / union > float(iou)).any():
            return
        if self.n == len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
        self.kept[self.n] = x1, y1, x2, y2
        self.n += 1
        yield tuple(table)


_BOX = T.StructType([
    T.StructField("frame_id", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("class_id", T.IntegerType()),
    *(T.StructField(c, T.DoubleType()) for c in ("confidence", "cx", "cy", "w", "h")),
])


@udtf
class Decode:
    """Boxes of a detection head's cells: v8 with distributions over 16 distances a side, or v5."""

    @staticmethod
    def analyze(table: AnalyzeArgument, classes: AnalyzeArgument, version: AnalyzeArgument = None, **other: AnalyzeArgument) -> AnalyzeResult:
        v8 = version is None or version.value != "v5"
        _columns(table, ("frame_id", "cell", "data", "scale", "pad_x", "pad_y", *(("grid_w",) if v8 else ())))
        return AnalyzeResult(schema=_BOX)

    def eval(self, table: Row, classes: int, version: str = "v8", threshold: float = 0.5, size: int = 640) -> Iterator[tuple]:
        data = np.asarray(table["data"], float)
        at = 4 if version == "v5" else 64
        scores = 1 / (1 + np.exp(-data[at : at + classes]))
        best = int(scores.argmax())
        if scores[best] < float(threshold):
            return
        scale, pad_x, pad_y = float(table["scale"]), table["pad_x"], table["pad_y"]
        if version == "v5":
            cx, cy, w, h = (data[0] - pad_x) / scale, (data[1] - pad_y) / scale, data[2] / scale, data[3] / scale
        else:
            sides = data[:64].reshape(4, 16)
            e = np.exp(sides - sides.max(1, keepdims=True))
            left, top, right, bottom = (e / e.sum(1, keepdims=True)) @ np.arange(16.0)
            (row, col), stride = divmod(table["cell"], table["grid_w"]), size / table["grid_w"]
            cx, cy = ((col + 0.5 + (right - left) / 2) * stride - pad_x) / scale, ((row + 0.5 + (bottom - top) / 2) * stride - pad_y) / scale
            w, h = (left + right) * stride / scale, (top + bottom) * stride / scale
        yield table["frame_id"], table["cell"], best, float(scores[best]), float(cx), float(cy), float(w), float(h)


def register(spark: SparkSession) -> None:
    spark.udtf.register("visorq_nms", Nms)
    spark.udtf.register("visorq_decode", Decode)
