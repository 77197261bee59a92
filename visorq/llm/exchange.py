"""Two-level exchange of packed columns between chunks of documents and buckets of content hashes.

Documents are dealt once to chunks by a hash of id and text, and stored so that later steps read their
chunk without another shuffle. Each chunk sends, per bucket of the hash space, one packed block with a row
per distinct content, so a passage that a third of all documents share costs one row per chunk. A bucket
answers each chunk with one bit per row, in the row's order. Answers are stored, which cuts the lineage;
the blocks of a step are freed before the next. A chunk can also send itself a note, its state for the
next step. What a chunk sends depends on its documents only, not on their order, so a recomputed task
sends the same again.

In memory a task holds one chunk or one bucket; their sizes are parameters, their number grows with the
input. A chunk sends a block to each bucket in which it has a row, hence at most one per row; larger
chunks and buckets, where executors have the memory, make fewer and larger blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import discard, materialize, materialize_bucketed, row_key, shuffle_partitions, text_bytes

BLOCK = "bucket int, chunk int, payload binary"
_NAMES = ["bucket", "chunk", "payload"]


def blocks(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=_NAMES)


def answers(table: pa.Table) -> np.ndarray:
    """The bits that all buckets answered, in the order of the buckets."""
    got = {b: p for b, p in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True) if b >= 0}
    return unpack_bits([got[b] for b in sorted(got)])


def notes(table: pa.Table) -> np.ndarray:
    """The bits that the chunk noted for itself."""
    return unpack_bits([p for b, p in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True) if b < 0])


def unpack_bits(payloads: list[bytes]) -> np.ndarray:
    parts = []
    for p in payloads:
        bits, n = K.unpack(p)
        parts.append(np.unpackbits(bits, count=int(n[0])))
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def pack_bits(bits: np.ndarray) -> bytes:
    return K.pack(np.packbits(bits), np.array([len(bits)], np.int64))


def note(chunk: int, bits: np.ndarray) -> tuple[int, int, bytes]:
    return (-1 - chunk, chunk, pack_bits(bits))


def split_sorted(bucket: np.ndarray):
    """(bucket, first, last) of the runs of a sorted bucket column."""
    return [(int(bucket[a]), a, b) for a, b in K.equal_runs(bucket)]


def distinct(h: np.ndarray, h2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each distinct value in it, place of each row): rows are equal if h and h2 are."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(h), bool)
    new[1:] = s[1:] != s[:-1]
    if h2 is not None and len(h):
        t = h2[order]
        if (~new[1:] & (t[1:] != t[:-1])).any():  # two contents with one first hash
            order = np.lexsort((h2, h))
            s, t = h[order], h2[order]
            new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def least_ids(ids: np.ndarray, order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least id, whether there are several) of each distinct value."""
    if not len(first):
        return ids[:0], np.zeros(0, bool)
    i = ids[order]
    least = np.minimum.reduceat(i, first)
    return least, np.maximum.reduceat(i, first) != least


class Prints:
    """Fingerprints of as few bits as keep chance repeats to one in a hundred or so, for asking whether
    contents repeat; a chance repeat only costs the work of a later step."""

    def __init__(self, total: int, buckets: int):
        self.bits, self.buckets = min(64, max(16, total.bit_length() + 6)), buckets

    def of(self, h: np.ndarray) -> np.ndarray:
        return h >> K.U(64 - self.bits)

    def bucket(self, f: np.ndarray) -> np.ndarray:
        return K.bucket_of(f << K.U(64 - self.bits), self.buckets)

    def send(self, chunk: int, f: np.ndarray, several: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Blocks of the sorted distinct fingerprints; several: whether two documents of the chunk have it."""
        out = []
        for b, x, y in split_sorted(self.bucket(f)):
            delta = np.diff(f[x:y], prepend=K.U(0))
            step = delta[1:].astype(np.uint32) if y - x > 1 and int(delta[1:].max()) < 2**32 else delta[1:]
            out.append((b, chunk, K.pack(delta[:1], step, np.packbits(several[x:y]))))
        return out

    def resolve(self, table: pa.Table) -> pa.Table:
        """Whether two documents have it, per sent fingerprint; notes are handed on."""
        if table["bucket"][0].as_py() < 0:
            return table.select(_NAMES)
        bucket, chunks = table["bucket"][0].as_py(), table["chunk"].to_pylist()
        fs, many = [], []
        for p in table["payload"].to_pylist():
            first, step, several = K.unpack(p)
            fs.append(np.cumsum(np.concatenate((first, step.astype(np.uint64))), dtype=np.uint64))
            many.append(np.unpackbits(several, count=len(fs[-1])).astype(bool))
        order, first, place = distinct(np.concatenate(fs))
        several = np.diff(np.append(first, len(order))) > 1
        several[place[np.concatenate(many)]] = True
        return _answer(bucket, chunks, [len(f) for f in fs], several[place])


def _answer(bucket: int, chunks: list[int], sizes: list[int], bits: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes).tolist()
    return blocks([(bucket, c, pack_bits(bits[e - n : e])) for c, e, n in zip(chunks, ends, sizes, strict=True)])


def send_least(chunk: int, h: np.ndarray, h2: np.ndarray, least: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Blocks of sorted distinct contents, by 128 bits, with the least id that has each in the chunk."""
    return [(b, chunk, K.pack(np.diff(h[x:y], prepend=K.U(0)), h2[x:y], least[x:y])) for b, x, y in split_sorted(K.bucket_of(h, buckets))]


def resolve_least(table: pa.Table) -> pa.Table:
    """Whether a document with a smaller id than the chunk's least has it, per sent content."""
    if table["bucket"][0].as_py() < 0:
        return table.select(_NAMES)
    bucket, chunks = table["bucket"][0].as_py(), table["chunk"].to_pylist()
    parts = [K.unpack(p) for p in table["payload"].to_pylist()]
    h, h2, ids = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    order, first, place = distinct(h, h2)
    least, _ = least_ids(ids, order, first)
    return _answer(bucket, chunks, [len(p[0]) for p in parts], least[place] < ids)


class Plan:
    """Chunks and buckets for a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, bucket_bytes: int):
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.spark = docs.sparkSession
        self.total = text_bytes(docs)
        self.chunks, self.buckets = max(1, -(-self.total // chunk_bytes)), max(1, -(-self.total // bucket_bytes))
        key = docs.select("*", *row_key("doc_id", "text"))  # not by id alone, which may be null or shared
        dealt = key.select("doc_id", "text", F.pmod("__r1", F.lit(self.chunks)).cast("int").alias("chunk"))
        self.docs = materialize_bucketed(dealt, "chunks", "chunk", shuffle_partitions(self.spark))

    def ask(self, send, resolve, known: DataFrame | None) -> DataFrame:
        """Stored answers (bucket, chunk, payload): chunks send, buckets resolve. known: answers of the
        step before, which are deleted."""
        by_chunk = self.docs.groupBy("chunk")
        sent = by_chunk.applyInArrow(send, BLOCK) if known is None else by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(send, BLOCK)
        out = materialize(sent.groupBy("bucket").applyInArrow(lambda table: resolve(table), BLOCK), "answers")
        discard(known)
        return out

    def finish(self, apply, known: DataFrame, schema: str) -> DataFrame:
        """The stored result of the last step."""
        out = materialize(self.docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(apply, schema), "dedup")
        discard(known, self.docs)
        return out
