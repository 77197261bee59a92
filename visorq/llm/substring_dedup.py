"""Substring deduplication over words by level-wise doubling.

The first level looks at windows of two words. Windows that occur in two documents survive; where two
surviving windows meet (the second begins where the first ends, or overlaps it at the last level), they are
extended to a window of twice the length, which is a candidate of the next level: 2, 4, 8 words, then the
asked length. A window that repeats at one length but whose extension doesn't goes no further, and the
doubling ends when the asked length is reached or no candidate survives. Levels below the last ask by short
fingerprints, whose chance repeats the next level drops; the last level tells windows apart by 128 bits and
finds the least document id that has each.

Defined cases: null or empty texts have no words; a text of fewer words than a window is left whole; ties
do not arise, as rows that share an id never remove from each other; a null id counts as larger than all
others; rows are returned one by one; an empty table gives an empty result; other input columns are not
read. A text is processed whole and must fit one task's memory (about 40 bytes per byte of text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kernel as K
from .exchange import Plan, Prints, answers, blocks, distinct, least_ids, note, notes, resolve_least, send_least


class _Slice:
    """Words of some whole texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, ids: np.ndarray):
        self.buf, self.offs, self.ids = buf, offs, ids
        self.starts, self.ends, self.rows = K.spans(buf, offs, K.WORDS)
        self.words = K.span_hash(buf, self.starts, self.ends)

    def whole(self, length: int) -> np.ndarray:
        """Per word, whether a window of the length begins there inside its text."""
        out = np.zeros(len(self.words), bool)
        n = len(self.words) - length + 1
        if n > 0:
            out[:n] = self.rows[:n] == self.rows[length - 1 :]
        return out

    def hashes(self, at: np.ndarray, length: int, second: bool = False) -> np.ndarray:
        """Hash of the windows that begin at ``at``."""
        if not len(at):
            return np.zeros(0, np.uint64)
        words = K.span_hash(self.buf, self.starts, self.ends, second=True) if second else self.words
        return K.window_hash(words, length)[at]


def _slices(table: pa.Table) -> list[_Slice]:
    ids = K.ids_of(table["doc_id"])
    buf, offs = K.text_buffer(table["text"])
    return [_Slice(part, at, ids[i:j]) for i, j, part, at in K.slices(buf, offs)]


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def levels_of(window: int, first: int = 2) -> list[int]:
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _extended(parts: list[_Slice], survived: np.ndarray, short: int, long: int) -> list[np.ndarray]:
    """Per slice the places of the windows of the longer length whose both ends survived at the shorter."""
    out, done = [], 0
    for s in parts:
        alive = survived[done : done + len(s.words)]
        done += len(s.words)
        both = s.whole(long)
        both[: len(both) - (long - short)] &= alive[: len(alive) - (long - short)] & alive[long - short :]
        out.append(np.flatnonzero(both))
    return out


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chunk_bytes: int = 2_500_000, bucket_bytes: int = 8_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the other words joined by one space) and spans
    (removed word ranges as start:end, comma-joined)."""
    plan = Plan(docs, id_col, text_col, chunk_bytes, bucket_bytes)
    prints, levels = Prints(plan.total, plan.buckets), levels_of(window)
    buckets = plan.buckets

    def survivors(parts: list[_Slice], known: pa.Table, level: int) -> np.ndarray:
        """Per word of the chunk, whether the candidate of that level that begins there survived."""
        at = _candidates(parts, notes(known), level)
        f = prints.of(_cat([s.hashes(a, levels[level]) for s, a in zip(parts, at, strict=True)], np.uint64))
        *_, place = distinct(f)
        bits = answers(known)[place] if len(f) else np.zeros(0, bool)
        out, done, base = np.zeros(sum(len(s.words) for s in parts), bool), 0, 0
        for s, a in zip(parts, at, strict=True):
            out[base + a] = bits[done : done + len(a)]
            done, base = done + len(a), base + len(s.words)
        return out

    def _candidates(parts: list[_Slice], survived: np.ndarray, level: int) -> list[np.ndarray]:
        if level == 0:
            return [np.flatnonzero(s.whole(levels[0])) for s in parts]
        return _extended(parts, survived, levels[level - 1], levels[level])

    def ask_level(level: int):
        def send(docs: pa.Table, known: pa.Table | None = None) -> pa.Table:
            if not docs.num_rows:
                return blocks([])
            chunk, parts = docs["chunk"][0].as_py(), _slices(docs)
            survived = survivors(parts, known, level - 1) if level else np.zeros(0, bool)
            at = _candidates(parts, survived, level)
            ids = _cat([s.ids[s.rows[a]] for s, a in zip(parts, at, strict=True)], np.int64)
            h = _cat([s.hashes(a, levels[level]) for s, a in zip(parts, at, strict=True)], np.uint64)
            if level == len(levels) - 1:
                h2 = _cat([s.hashes(a, levels[level], True) for s, a in zip(parts, at, strict=True)], np.uint64)
                order, first, _ = distinct(h, h2)
                least, _ = least_ids(ids, order, first)
                return blocks([note(chunk, survived), *send_least(chunk, h[order][first], h2[order][first], least, buckets)])
            f = prints.of(h)
            order, first, _ = distinct(f)
            _, several = least_ids(ids, order, first)
            return blocks([note(chunk, survived), *prints.send(chunk, f[order][first], several)])

        return send if level else lambda docs: send(docs)

    def apply(docs: pa.Table, known: pa.Table) -> pa.Table:
        out = {"n_words": [], "n_removed": [], "kept": [], "spans": []}
        if docs.num_rows:
            parts = _slices(docs)
            at = _candidates(parts, notes(known), len(levels) - 1)
            h, h2 = (_cat([s.hashes(a, window, k) for s, a in zip(parts, at, strict=True)], np.uint64) for k in (False, True))
            ids = _cat([s.ids[s.rows[a]] for s, a in zip(parts, at, strict=True)], np.int64)
            order, first, place = distinct(h, h2)
            least, _ = least_ids(ids, order, first)
            gone_at = (answers(known)[place] | (ids > least[place])) if len(h) else np.zeros(0, bool)
            done = 0
            for s, a in zip(parts, at, strict=True):
                hit = a[gone_at[done : done + len(a)]]
                done += len(a)
                _cut_words(s, *K.merged_runs(hit, hit + window), out)
        cols = [docs["doc_id"].cast(pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["spans"], pa.string())]
        return pa.table(cols, names=["doc_id", *out])

    known = None
    for level in range(len(levels)):
        known = plan.ask(ask_level(level), resolve_least if level == len(levels) - 1 else prints.resolve, known)
    return plan.finish(apply, known, "doc_id long, n_words long, n_removed long, kept string, spans string")


def _cut_words(s: _Slice, a: np.ndarray, b: np.ndarray, out: dict[str, list]) -> None:
    """Append the texts of a slice without the words of the runs a..b."""
    edge = np.zeros(len(s.words) + 1, np.int32)
    edge[a], edge[b] = 1, edge[b] - 1
    gone = np.cumsum(edge[:-1]).astype(bool)
    raw = s.buf.tobytes()
    first = np.searchsorted(s.rows, np.arange(len(s.offs)))
    pairs = list(zip(s.starts.tolist(), s.ends.tolist(), strict=True))
    runs = [[] for _ in range(len(s.offs) - 1)]
    for r, x, y in zip(s.rows[a].tolist(), a.tolist(), b.tolist(), strict=True):
        # a run of touching windows may pass from one text to the next
        while y > first[r + 1]:
            runs[r].append((x - first[r], first[r + 1] - first[r]))
            x = first[r + 1]
            r = int(s.rows[x])
        runs[r].append((x - first[r], y - first[r]))
    for r in range(len(s.offs) - 1):
        x, y = int(first[r]), int(first[r + 1])
        lost = gone[x:y]
        keep = pairs[x:y] if not lost.any() else [pairs[x + k] for k in np.flatnonzero(~lost).tolist()]
        out["n_words"].append(y - x)
        out["n_removed"].append(int(lost.sum()))
        out["kept"].append(b" ".join([raw[p:q] for p, q in keep]).decode())
        out["spans"].append(",".join(f"{p}:{q}" for p, q in runs[r]))
