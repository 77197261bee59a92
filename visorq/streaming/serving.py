"""Structured Streaming: micro-batch scoring, event-time windows and a keyed registry state; and an engine of
concurrent batch requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def request_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Every micro-batch is scored as one DataFrame and handed to the sink with its id; a sink that
    overwrites by id is exactly-once."""
    return requests.writeStream.foreachBatch(lambda df, i: sink(score(df), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(requests: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    timed = requests.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", window), key).agg(F.count(F.lit(1)).alias("requests"))


class Registry(StatefulProcessor):
    """What is known of one model: version, a version that waits, references, last use, errors."""

    def __init__(self, strict: bool):
        self.strict = strict

    def init(self, handle) -> None:
        self.state = handle.getValueState("model", "version long, waiting long, refs long, used long, errors long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, waiting, refs, used, errors = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0)
        for op, ts, given in pd.concat(list(rows)).sort_values("ts", kind="stable")[["op", "ts", "version"]].itertuples(index=False):
            new = int(given) if pd.notna(given) else max(version, waiting) + 1
            if op in ("load", "replace") and not refs:
                version, waiting = new, 0
            elif op in ("load", "replace"):
                waiting = new
            elif op == "unload":
                version = waiting = refs = 0
            elif op == "acquire":
                errors += int(self.strict and not version)
                refs, used = refs + 1, max(used, int(ts))
            elif op == "touch":
                used = max(used, int(ts))
            elif op == "release":
                errors += int(not refs)
                refs, used = max(0, refs - 1), max(used, int(ts))
                if not refs and waiting:
                    version, waiting = waiting, 0
        self.state.update((version, waiting, refs, used, errors))
        yield pd.DataFrame({"name": [key[0]], "ref_count": [refs], "last_used": [used], "version": [version], "waiting": [waiting], "errors": [errors]})

    def close(self) -> None:
        pass


def registry_state(log: DataFrame) -> DataFrame:
    """Per model its version, references and last use, from a log (name, op, ts, and version, null where not given)
    kept as state. It needs the RocksDB store: ``spark.sql.streaming.stateStore.providerClass``.

    op: load and replace (the given version, or one more than the last; a replacement waits until nobody holds
    the model), acquire and release, touch, unload. Acquiring a model that isn't loaded, and releasing one that
    nobody holds, count as errors."""
    strict = "version" in log.columns  # a log without versions tells nothing of loading
    if not strict:
        log = log.withColumn("version", F.lit(None).cast("long"))
    schema = "name string, ref_count long, last_used long, version long, waiting long, errors long"
    return log.groupBy("name").transformWithStateInPandas(Registry(strict), schema, "update", "None")


class Batcher(StatefulProcessor):
    """Requests of one model gathered in a list until there are ``most``, or until ``delay_ms`` after the first of them; then
    all that are pending go out as one batch. The list is keyed state and the delay a processing-time timer, so both
    outlive a lost executor and a restart."""

    def __init__(self, most: int, delay_ms: int):
        self.most, self.delay_ms = most, delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "request_id long")
        self.number = handle.getValueState("number", "batch long")

    def _flush(self, key, ids: list[int], why: str) -> Iterator[pd.DataFrame]:
        batch = self.number.get()[0] if self.number.exists() else 0
        self.number.update((batch + 1,))
        self.pending.clear()
        yield pd.DataFrame({"model": key[0], "batch": batch, "request_id": ids, "size": len(ids), "flush": why})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.pending.get()] if self.pending.exists() else []
        waiting = bool(held)
        for part in rows:
            held += part["request_id"].tolist()
        if len(held) >= self.most:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            yield from self._flush(key, held, "full")
            return
        self.pending.put([(int(i),) for i in held])
        if held and not waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            yield from self._flush(key, [r[0] for r in self.pending.get()], "late")

    def close(self) -> None:
        pass


def timed_batches(requests: DataFrame, model: str, id_col: str, most: int = 32, delay_ms: int = 5) -> DataFrame:
    """model, batch, request_id, size, flush (full or late) of a stream of requests. Its state needs the RocksDB store:
    ``spark.sql.streaming.stateStore.providerClass``."""
    rows = requests.select(F.col(model).cast("string").alias("model"), F.col(id_col).cast("long").alias("request_id"))
    schema = "model string, batch long, request_id long, size long, flush string"
    return rows.groupBy("model").transformWithStateInPandas(Batcher(most, delay_ms), schema, "append", "ProcessingTime")


class Engine:
    """Scoring functions by name, run beside each other as Spark jobs; the Python face of a model server."""

    def __init__(self, workers: int = 4):
        self._pool = ThreadPoolExecutor(workers)
        self._models: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}
        self._lock = Lock()
        self._open = True

    def load(self, name: str, score: Callable[[DataFrame], DataFrame], version: int | None = None) -> int:
        """Loads or replaces a model; requests that run keep the one they began with."""
        with self._lock:
            version = version or self._models.get(name, (0, None))[0] + 1
            self._models[name] = version, score
        return version

    def unload(self, name: str) -> None:
        with self._lock:
            self._models.pop(name, None)

    def versions(self) -> dict[str, int]:
        with self._lock:
            return {n: v for n, (v, _) in self._models.items()}

    def submit(self, name: str, requests: DataFrame, done: Callable[[list], None] | None = None) -> Future:
        """The rows of the scored requests, later; ``done`` gets them as well. A model that isn't loaded, and an
        engine that is shut down, are errors of the future."""
        out: Future = Future()
        with self._lock:
            known, is_open = self._models.get(name), self._open
        if not is_open or known is None:
            out.set_exception(RuntimeError("the engine is shut down") if not is_open else KeyError(f"model {name} isn't loaded"))
            return out

        def run() -> list:
            rows = known[1](requests).collect()
            if done:
                done(rows)
            return rows

        return self._pool.submit(run)

    def infer(self, name: str, requests: DataFrame, timeout: float | None = None) -> list:
        return self.submit(name, requests).result(timeout)

    def shutdown(self) -> None:
        """Ends what runs, and cancels what waits."""
        with self._lock:
            self._open = False
        self._pool.shutdown(wait=True, cancel_futures=True)
