"""Shared storage, input and sizing helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Stored steps that are still there, by the frame that reads them.
_STORED: dict[int, tuple[object, str]] = {}
_TABLES: dict[int, str] = {}
#: Other folders that go with them.
_FOLDERS: list[str] = []
#: Removes a query's shuffle files when it ends; what reads the stored result needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Slots of ids that are broadcast ahead of a join: at most so many rows, and only where no more ids are wanted.
SLOTS = 1 << 18
#: A key with more than one row in so many is hot; there are at most so many hot keys.
HOT_SHARE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; any other master must set
    it, as a machine-local folder would not be seen by the executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="visorq-")
        atexit.register(shutil.rmtree, own, True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/visorq/{tag}-{uuid.uuid4().hex}"


def own_folder(spark: SparkSession, tag: str) -> str:
    """A folder in the shared one that is deleted with the stored steps."""
    _FOLDERS.append(fresh_path(spark, tag))
    return _FOLDERS[-1]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the actions inside; what was set before comes back."""
    names = {"cleanup": _CLEANUP, "batch": _BATCH}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str, batch_rows: int = 1000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe against lost executors.

    batch_rows: rows in an Arrow batch while it is written, so that long texts stay within a worker's
    memory."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with settings(spark, cleanup="true", batch=str(batch_rows)):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = out, path
    return out


def materialize_bucketed(df: DataFrame, tag: str, col: str, parts: int) -> DataFrame:
    """As ``materialize``, but dealt out by ``col`` into ``parts`` files that Spark knows as buckets: later
    groupings by ``col`` read them without a shuffle. The table's name is temporary, its files are in the
    shared folder."""
    spark = df.sparkSession
    path, name = fresh_path(spark, tag), f"visorq_{uuid.uuid4().hex}"
    with settings(spark, cleanup="true"):
        writer = df.repartition(parts, col).write.option("compression", "zstd").option("path", path)
        writer.bucketBy(parts, col).format("parquet").saveAsTable(name)
    out = spark.table(name)
    _STORED[id(out)] = out, path
    _TABLES[id(out)] = name
    return out


def delete_path(path: str) -> None:
    """Remove a stored folder. A store that pyarrow can't open keeps it until ``clear``'s owner does."""
    from pyarrow import fs

    try:
        store, at = fs.FileSystem.from_uri(path)
    except Exception:  # noqa: BLE001  no client for this store: the folder stays
        return
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)


def discard(*frames: DataFrame | None) -> None:
    """Delete stored steps that no later step reads. Frames that aren't stored steps are let alone."""
    for df in frames:
        if df is not None and id(df) in _STORED:
            if id(df) in _TABLES:
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(id(df))}")
            delete_path(_STORED.pop(id(df))[1])


def clear() -> None:
    """Delete all stored steps of this process, also those that a returned result reads: call it when
    results have been written. It runs by itself when the process ends."""
    while _STORED:
        delete_path(_STORED.popitem()[1][1])
    _TABLES.clear()
    while _FOLDERS:
        delete_path(_FOLDERS.pop())


atexit.register(clear)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; used to size chunks and buckets, never to drop rows."""
    row = df.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()
    return int(row["n"] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For results that are returned unstored: Arrow batches of at most ``rows`` rows from now on, so
    that long texts stay within a worker's memory. Stored steps set and restore it by themselves."""
    spark.conf.set(_BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes, __r1 and __r2, of a row's deciding columns. Rows are told apart by what they
    hold, not by an id that may be null or shared; rows that agree in all of these columns are one."""
    held = [x for c in (F.col(c) if isinstance(c, str) else c for c in cols) for x in (c.isNull(), c)]
    return [F.xxhash64(*held).alias("__r1"), F.xxhash64(F.lit("second"), *held).alias("__r2")]


def join_by_counts(rows: DataFrame, info: DataFrame, keys: list[str], n_col: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``info``, which has each key once and in ``n_col`` how many rows
    have it, of ``total``.

    Keys with more than one row in ``HOT_SHARE`` are at most that many: they are broadcast, and their
    rows never meet in one task. All others are joined by a shuffle."""
    hot = info.filter(F.col(n_col) * HOT_SHARE > total)
    often = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return often.unionByName(rest.join(info.filter(F.col(n_col) * HOT_SHARE <= total), keys, how))


def split_by_slots(rows: DataFrame, at: Column, wanted: DataFrame, by: Column) -> tuple[DataFrame, DataFrame]:
    """(likely, rest): rows whose ``at`` may be among the ``by`` of ``wanted``, which is stored, and rows whose isn't.

    The values are hashed to a fixed number of slots, which are broadcast and spare the rest a shuffle. Where more
    values are wanted than there are slots, nothing is broadcast and all rows are likely."""
    if wanted.count() > SLOTS:
        return rows, rows.filter(F.lit(False))
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit("slot")), F.lit(SLOTS)).cast("int")
    taken = F.broadcast(wanted.select(slot(by).alias("__slot")).distinct())
    marked = rows.withColumn("__slot", slot(at))
    return marked.join(taken, "__slot", "left_semi").drop("__slot"), marked.join(taken, "__slot", "left_anti").drop("__slot")
