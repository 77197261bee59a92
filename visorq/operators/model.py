"""Model inference on frames: any backend behind one protocol, loaded once per worker and kept."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Idle backends that a worker keeps per model; the one used longest ago goes first.
MOST_IDLE = 4
_IDLE: dict[str, OrderedDict[int, Backend]] = {}


class Backend(Protocol):
    """A loaded model: tensors of one frame to output tensors."""

    def infer(self, tensors: list[np.ndarray]) -> list[np.ndarray]: ...


class ChannelMeans:
    """A deterministic stand-in: the mean of each channel, and the tensor's mean."""

    def infer(self, tensors: list[np.ndarray]) -> list[np.ndarray]:
        return [t.mean(axis=(2, 3), dtype=np.float64) for t in tensors] + [np.array([[t.mean(dtype=np.float64)] for t in tensors])]


def acquire(model: str, load: Callable[[str], Backend]) -> Backend:
    """An idle backend of the model in this worker, or a new one."""
    idle = _IDLE.get(model)
    return idle.popitem()[1] if idle else load(model)


def release(model: str, backend: Backend) -> None:
    idle = _IDLE.setdefault(model, OrderedDict())
    idle[id(backend)] = backend
    while len(idle) > MOST_IDLE:
        idle.popitem(last=False)


def infer(frames: DataFrame, model: str, load: Callable[[str], Backend] = lambda model: ChannelMeans()) -> DataFrame:
    """frame_id and outputs, an array of (shape, data), of frames (frame_id, shape, data: height x width x channels).

    Each frame is one tensor 1 x channels x height x width. A frame whose data don't fill its shape is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = acquire(model, load)
        try:
            for batch in batches:
                out = []
                for shape, data in zip(batch["shape"], batch["data"], strict=True):
                    tensor = np.asarray(data, np.float64).reshape(tuple(shape)).transpose(2, 0, 1)[None]
                    out.append([{"shape": list(t.shape), "data": t.reshape(-1).tolist()} for t in backend.infer([tensor])])
                yield pd.DataFrame({"frame_id": batch["frame_id"], "outputs": out})
        finally:
            release(model, backend)

    return frames.select("frame_id", "shape", "data").mapInPandas(run, "frame_id long, outputs array<struct<shape:array<int>,data:array<double>>>")
