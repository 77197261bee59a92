"""Fuzzy line deduplication by MinHash over character shingles.

Lines are split at newlines. Equal lines, told by 128 bits, form one node; each node's character shingles
give a MinHash signature, whose bands propose candidates with high recall; candidates are verified by the
exact Jaccard similarity of their shingle sets (``lsh``); distributed union-find closes the links; and the
first line of each component, by document id and line number, stays.

Defined cases: null text counts as empty (no lines); lines without a word always stay; a line of fewer
characters than a shingle is one shingle; rows are told apart by id and text together, so rows with a
null id or that share an id lose only lines of their own, while rows that agree in both are one document
and lose the same lines; lines of rows with a null id come last in the order, those of rows that share an
id in the order of a hash of their texts; an empty table gives an empty result; other input columns are
returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import discard, join_by_counts, materialize, row_key, split_by_slots
from .lsh import GROUP_ROWS, hub_members, link
from .near_dup import band_keys

_NOT_NEWLINE = K.byte_set(b"\n")


def char_shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each line): shingles of ``size`` characters of the byte spans; a
    shorter line is one shingle."""
    chars = np.flatnonzero((buf & 0xC0) != 0x80)
    a, b = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    n = np.maximum(b - a - size + 1, 1)
    heads = np.cumsum(n) - n
    at = np.repeat(a - heads, n) + np.arange(n.sum())
    first = chars[at]
    stop = np.append(chars, len(buf))[np.minimum(at + size, len(chars))]
    return K.span_hash(buf, first, np.minimum(stop, np.repeat(ends, n))), heads


#: Shingles that are hashed at a time, few enough for a core's cache.
_BLOCK = 1 << 16


def _minima(x: np.ndarray, heads: np.ndarray, coordinates: int) -> np.ndarray:
    """(coordinates, lines): MinHash signatures of the lines whose mixed shingle hashes begin at ``heads``."""
    mult = np.random.default_rng(977).integers(0, 2**32, coordinates, dtype=np.uint32) | np.uint32(1)
    sig = np.empty((coordinates, len(heads)), np.uint32)
    ends = np.append(heads[1:], len(x))
    i = 0
    while i < len(heads):
        j = max(i + 1, int(np.searchsorted(ends, heads[i] + _BLOCK)))
        part, at = x[heads[i] : ends[j - 1]], heads[i:j] - heads[i]
        t = np.empty_like(part)
        for k in range(coordinates):
            np.multiply(part, mult[k], out=t)
            np.minimum.reduceat(t, at, out=sig[k, i:j])
        i = j
    return sig


def line_signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """The columns of ``docs`` but its last, the text; line (number), h1 and h2 (the line's 128-bit name)
    and bands (keys, one per band, which equal lines of a slice have once)."""
    kept = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.text_buffer(batch.column(len(kept)))
            for i, _, part, at in K.slices(buf, offs, K.SLICE):
                starts, ends, owner = K.spans(part, at, _NOT_NEWLINE)
                worded = np.concatenate(([0], np.cumsum(K.WORDS[part])))
                some = worded[ends] > worded[starts]
                starts, ends, owner = starts[some], ends[some], owner[some]
                if not len(starts):
                    continue
                breaks = np.concatenate(([0], np.cumsum(part == 10)))
                line = breaks[starts] - breaks[at[owner]]
                h1, h2 = K.span_hash(part, starts, ends), K.span_hash(part, starts, ends, second=True)
                new = np.zeros(len(starts), bool)
                new[K.first_of_pairs(h1, h2)] = True
                h, heads = char_shingles(part, starts[new], ends[new], shingle)
                sig = _minima(K.mix32((h >> K.U(32)).astype(np.uint32)), heads, bands * rows)
                keys = np.ascontiguousarray(band_keys(sig, rows).T).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(new * bands))).astype(np.int32)), pa.array(keys))
                from_row = pa.array(owner + i)
                yield pa.record_batch(
                    [*(c.take(from_row) for c in batch.columns[:-1]), pa.array(line.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists],
                    names=[*kept, "line", "h1", "h2", "bands"],
                )
        K.trim()

    ahead = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{ahead}, line int, h1 long, h2 long, bands array<long>")


def _sets(shingle: int):
    def sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = offs[:-1], offs[1:]
        some = ends > starts
        h, heads = char_shingles(buf, starts[some], ends[some], shingle)
        bounds = np.zeros(len(offs), np.int64)
        bounds[1:][some] = np.diff(np.append(heads, len(h)))
        return K.distinct_in_rows(h, np.cumsum(bounds))

    return sets


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__r1, __r2 (the row's key), d (the id, null as the largest) and text."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(*row_key(doc_id, text), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("d"), text.alias("text"))


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the lines (id, __r1, __r2, line): they are cut from the documents that hold them."""
    per_row = wanted.groupBy("__r1", "__r2").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    likely, _ = split_by_slots(docs, F.col("__r1"), wanted, F.col("__r1"))
    found = likely.join(per_row, ["__r1", "__r2"]).select("wanted", F.split("text", "\n").alias("lines"))
    cut = found.select(F.explode(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), F.get("lines", w["line"]).alias("text")))).alias("x"))
    return cut.select("x.id", "x.text").dropDuplicates(["id"])


_PLACE = ("__r1", "__r2", "line")


def duplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 7, percent: int = 80, bands: int = 16, rows: int = 5, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(__r1, __r2, line), stored: the lines to remove, by their row's key (``row_key`` of id and text). With
    16 bands of 5 rows a pair at similarity 0.8 shares a bucket with probability 0.998, one at 0.9 with 0.999999."""
    docs = _keyed(docs, id_col, text_col)
    lines = materialize(line_signatures(docs, shingle, bands, rows), "lines")
    total = lines.count()
    some = [F.first(c).alias(c) for c in _PLACE]  # of one and the same row
    by_h1 = lines.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.min("h2").alias("h2"), F.max("h2").alias("x2"), *some)
    by_h1 = materialize(by_h1, "line-classes")
    mixed = by_h1.filter("h2 <> x2").select("h1")
    classes = by_h1.filter("h2 = x2").select("h1", "h2", "n", *_PLACE, F.col("h1").alias("node"))
    banded = lines.filter(F.size("bands") > 0).select("h1", "h2", "bands")
    nodes = banded.select(F.col("h1").alias("id"), "bands")
    if mixed.count():  # different lines with one h1: both hashes together make the class and its node
        own = F.xxhash64("h1", "h2")
        shared = lines.join(mixed, "h1", "left_semi").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), *some)
        classes = classes.unionByName(shared.withColumn("node", own))
        nodes = banded.join(mixed, "h1", "left_anti").select(F.col("h1").alias("id"), "bands").unionAll(banded.join(mixed, "h1", "left_semi").select(own.alias("id"), "bands"))
    members = hub_members(nodes)
    ids = members.select("id").unionAll(members.select(F.col("hub").alias("id"))).distinct()
    wanted = materialize(classes.join(ids, classes["node"] == ids["id"]).drop("node"), "wanted")
    texts = materialize(_line_texts(docs, wanted), "line-texts")
    comps = link(members, texts, _sets(shingle), percent, group_rows)
    linked = wanted.join(comps, wanted["id"] == comps["node"]).select("h1", "h2", "n", F.col("component").alias("comp"), F.lit(0).cast("long").alias("other"))
    # h2 tells classes apart that are in no component
    repeated = classes.filter("n > 1").join(comps.select("node"), "node", "left_anti")
    alone = repeated.select("h1", "h2", "n", F.col("h1").alias("comp"), F.col("h2").alias("other"))
    info = materialize(linked.unionAll(alone), "repeated-classes")
    discard(members, wanted, texts, comps, by_h1)
    found = join_by_counts(lines.drop("bands"), info, ["h1", "h2"], "n", total).select("d", "__r1", "__r2", "line", "comp", "other")
    found = materialize(found, "repeated-lines")
    discard(info)
    place = F.struct("d", "__r1", "__r2", "line")
    first = found.groupBy("comp", "other").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    gone = join_by_counts(found, first, ["comp", "other"], "n", total).filter(place != F.col("first")).select("__r1", "__r2", "line")
    out = materialize(gone, "gone")
    discard(found, lines)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with all their columns, the text without its duplicate lines, and n_lines
    and n_removed in a struct column ``line_dedup`` (with underscores after it while ``docs`` has that name)."""
    stats = "line_dedup"
    while stats.lower() in (c.lower() for c in docs.columns):
        stats += "_"
    lost = duplicate_lines(docs, id_col, text_col, **how)
    gone = materialize(lost.groupBy("__r1", "__r2").agg(F.collect_set("line").alias("gone")), "gone-lines")
    discard(lost)
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", *row_key(F.col(f"row.`{id_col}`").cast("long"), text))
    # only texts with removals are put together anew; all others pass unchanged, and mostly without a shuffle
    likely, rest = split_by_slots(rows, F.col("__r1"), gone, F.col("__r1"))
    both = likely.join(gone, ["__r1", "__r2"], "left").unionByName(rest.withColumn("gone", F.lit(None).cast("array<int>"))).select(
        "row", F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone")
    )
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    counts = F.struct(F.size(F.filter("lines", lambda x: x != "")).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))
    cols = [F.when(F.size("gone") == 0, text).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return both.select(*cols, counts.alias(stats))
