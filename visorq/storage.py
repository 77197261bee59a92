"""Where steps of a job are kept between its rounds: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="visorq-steps-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


_STORED: dict[int, tuple[DataFrame, str]] = {}


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with no lineage, safe against lost executors.

    It stays until ``discard``, or until the process ends."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = out, path
    return out


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/visorq-steps/{tag}-{uuid.uuid4().hex}"


def _delete(path: str) -> None:
    """Remove a stored step. A store that pyarrow can't open keeps it."""
    from pyarrow import fs

    try:
        store, at = fs.FileSystem.from_uri(path)
    except Exception:  # noqa: BLE001  no client for this store
        return
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)


def discard(*frames: DataFrame | None) -> None:
    """Delete stored steps that nothing reads any more; other frames are let alone."""
    for df in frames:
        if df is not None and id(df) in _STORED:
            _delete(_STORED.pop(id(df))[1])


def clear() -> None:
    """Delete all stored steps of this process, also those that a returned result reads."""
    while _STORED:
        _delete(_STORED.popitem()[1][1])


atexit.register(clear)
