"""Bank files as a data source: ``spark.read.format("bank")`` and ``df.write.format("bank")``.

A bank file is a header and records of one length, so a range of records can be read without the rest: large files are split
into partitions of at most ``recordsPerPartition`` records. Writing is in two steps: every task writes files of at most
``recordsPerFile`` records under names that readers don't see, and the commit renames those of the tasks that
succeeded; what a failed job left is deleted.

The columns are those of ``read_banks``. Paths are any that pyarrow opens; ``path`` is a folder or one file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import BANK_MAGIC, BANK_MAGIC_LEGACY

SCHEMA = "path string, features array<double>, layer_idx int, patch_row int, patch_col int, mean array<double>, std array<double>"
#: Records that are decoded at a time.
_SLICE = 20_000


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Header:
    count: int
    dim: int
    start: int
    mean: list[float] | None = None
    std: list[float] | None = None

    @classmethod
    def read(cls, f) -> Header:
        head = f.read(17)
        magic = struct.unpack_from("<I", head)[0] if len(head) >= 4 else 0
        if magic == BANK_MAGIC_LEGACY and len(head) >= 12:
            return cls(*struct.unpack_from("<II", head, 4), 12)
        if magic != BANK_MAGIC or len(head) < 17:
            raise ValueError("not a bank file")
        _, _, count, dim, normed = struct.unpack("<IIIIB", head)
        if not normed:
            return cls(count, dim, 17)
        both = np.frombuffer(f.read(8 * dim), "<f4").astype(float)
        return cls(count, dim, 17 + 8 * dim, both[:dim].tolist(), both[dim:].tolist())

    @property
    def record(self) -> np.dtype:
        return np.dtype([("f", "<f4", (self.dim,)), ("p", "<i4", (3,))])


@dataclass
class Range(InputPartition):
    path: str
    header: Header
    first: int
    count: int


class BankReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, at = _open(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at))
        out, prefix = [], self.path[: -len(at)] if self.path.endswith(at) else ""
        for x in sorted(found, key=lambda x: x.path):
            if x.is_file and x.base_name.endswith(".bin") and not x.base_name.startswith("."):
                with store.open_input_file(x.path) as f:
                    head = Header.read(f)
                if x.size < head.start + head.count * head.record.itemsize:
                    raise ValueError(f"{x.path} is shorter than its header says")
                out += [Range(prefix + x.path, head, i, min(self.most, head.count - i)) for i in range(0, head.count, self.most)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder has no partitions
            return
        head, size = partition.header, partition.header.record.itemsize
        store, at = _open(partition.path)
        with store.open_input_file(at) as f:
            f.seek(head.start + partition.first * size)
            for i in range(0, partition.count, _SLICE):
                n = min(_SLICE, partition.count - i)
                rec = np.frombuffer(f.read(n * size), head.record)
                lists = lambda a, k: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * k), pa.array(a.astype(float).ravel()))
                normal = lambda x: pa.array([x] * n, pa.list_(pa.float64()))  # noqa: B023, E731
                places = [pa.array(rec["p"][:, j].astype(np.int32)) for j in range(3)]
                cols = [pa.array([partition.path] * n), lists(rec["f"].reshape(n, head.dim), head.dim), *places, normal(head.mean), normal(head.std)]
                yield pa.record_batch(cols, names=["path", "features", "layer_idx", "patch_row", "patch_col", "mean", "std"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class BankWriter(DataSourceArrowWriter):
    """Rows features, layer_idx, patch_row, patch_col to bank files; other columns are not stored."""

    def __init__(self, path: str, most: int, overwrite: bool):
        self.path, self.most, self.overwrite, self.job = path, most, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        held, count, files, task = [], 0, [], uuid.uuid4().hex

        def put(records: np.ndarray) -> None:
            dim = records.dtype["f"].shape[0]
            part = f"{at}/.{self.job}-{task}-{len(files)}"
            with store.open_output_stream(part) as f:
                f.write(struct.pack("<IIIIB", BANK_MAGIC, 1, len(records), dim, 0))
                f.write(records.tobytes())
            files.append((part, f"{at}/part-{task}-{len(files)}.bin"))

        for batch in iterator:
            if not batch.num_rows:
                continue
            features = batch.column(batch.schema.get_field_index("features"))
            size = np.unique(np.diff(features.offsets.to_numpy()))
            if len(size) != 1 or features.null_count or (held and held[0].dtype["f"].shape[0] != size[0]):
                raise ValueError("a bank's features are of one length")
            rec = np.zeros(batch.num_rows, np.dtype([("f", "<f4", (int(size[0]),)), ("p", "<i4", (3,))]))
            rec["f"] = features.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for j, name in enumerate(("layer_idx", "patch_row", "patch_col")):
                rec["p"][:, j] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            held.append(rec)
            count += len(rec)
            while count >= self.most:
                whole = np.concatenate(held)
                put(whole[: self.most])
                held, count = [whole[self.most :]], count - self.most
        if count:
            put(np.concatenate(held))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = _open(self.path)
        new = [x for m in messages if m for x in m.files]
        old = [x.path for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.base_name.endswith(".bin")] if self.overwrite else []
        for part, name in new:
            store.move(part, name)
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What this job left under hidden names, failed and repeated tasks' included."""
        from pyarrow import fs

        store, at = _open(self.path)
        for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if x.base_name.startswith(f".{self.job}-"):
                store.delete_file(x.path)


class BankSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bank"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BankReader:
        return BankReader(self.options["path"], int(self.options.get("recordsPerPartition", 1_000_000)))

    def writer(self, schema, overwrite: bool) -> BankWriter:
        missing = {"features", "layer_idx", "patch_row", "patch_col"} - set(schema.names)
        if missing:
            raise ValueError(f"a bank needs the columns {sorted(missing)}")
        return BankWriter(self.options["path"], int(self.options.get("recordsPerFile", 1_000_000)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BankSource)
