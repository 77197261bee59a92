"""Suffix-array dedup over bytes: a common-prefix-aware distributed merge sort of anchored suffixes.

Which suffixes: each 50-byte string contains anchors, the least-hashed 14-byte gram inside it; the string
is found through the suffix at its anchor together with the bytes before it. Consecutive strings with
one anchor make one unit, so about one suffix in nineteen is sorted and no string is lost.

Distinguishing prefixes: as in prefix-doubling string sorting, a hash exchange first finds the suffixes
whose 14-byte prefix occurs in one document only. They differ from all others within those bytes and
need not be exchanged. (A chance agreement of hashes only lets a suffix through.)

Merge sort: each chunk sorts its units (bucket of the prefix, then the bytes from the anchor on, then the
bytes before it, backwards), merges equal ones and sends per bucket a front-coded run: common prefix
lengths and the bytes beyond them. A bucket merges its runs with a loser tree over offset-value codes:
a code holds where a string first differs from the last output and the bytes there. The codes of a run
come from the common prefix lengths that were sent, most matches are decided by one integer comparison,
and prefixes known to be common are never compared again.

Answers: the merge also yields the common prefix of neighbours. For a string whose anchor is preceded by o
of its bytes, the units that share its bytes from the anchor on are an interval of the merged order whose
common prefixes reach 50 - o, and those that share the bytes before are an interval of the same kind in the
order of the backward prefixes. Equal pairs of intervals are equal strings, byte for byte; the least document
id of each is the answer.

Defined cases: null or empty texts, and texts of fewer than 50 bytes, lose nothing; ties do not arise, as
rows that share an id never remove from each other; a null id counts as larger than all others; rows are
returned one by one; an empty table gives an empty result; other input columns are not read. A text is
processed whole and must fit one task's memory (about 60 bytes per byte of text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kernel as K
from .exchange import Plan, Prints, answers, blocks, distinct, least_ids, note, notes, pack_bits, split_sorted

_GRAM = 14
_STEP = 7
_TOP = 56


class _Slice:
    """Anchored suffixes of some whole texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, ids: np.ndarray, length: int):
        self.buf, self.offs, self.ids = buf, offs, ids
        ends = np.repeat(offs[1:], np.diff(offs))
        grams = K.gram_hash(buf, _GRAM)
        self.anchor, self.first, self.count = K.anchor_units(grams, ends, len(buf), length, _GRAM)
        # mixed anew: the hashes of anchors are least ones and would crowd the first buckets
        self.hash = K.mix64(grams[self.anchor])
        self.owner = ids[np.searchsorted(offs, self.anchor, "right") - 1]


def _slices(table: pa.Table, length: int) -> list[_Slice]:
    ids = K.ids_of(table["doc_id"])
    buf, offs = K.text_buffer(table["text"])
    return [_Slice(part, at, ids[i:j], length) for i, j, part, at in K.slices(buf, offs, 1_000_000)]


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _layout(length: int) -> tuple[int, int]:
    """(bytes for the part from the anchor on, bytes of a row): each part is followed by its length."""
    width = length + 1 + (length - _GRAM) + 1
    return length, -(-width // _STEP) * _STEP


def unit_rows(s: _Slice, alive: np.ndarray, length: int) -> np.ndarray:
    """One fixed-width row per living unit: suffix from the anchor, its length, prefix backwards, its length."""
    right, width = _layout(length)
    anchor, first = s.anchor[alive], s.first[alive]
    end = first + s.count[alive] + length - 1
    rlen, llen = end - anchor, anchor - first
    rows = np.zeros((len(anchor), width), np.uint8)
    if len(anchor):
        at = anchor[:, None] + np.arange(right)
        rows[:, :right] = np.where(np.arange(right) < rlen[:, None], s.buf[np.minimum(at, len(s.buf) - 1)], 0)
        rows[:, right] = rlen
        left = length - _GRAM
        at = anchor[:, None] - 1 - np.arange(left)
        rows[:, right + 1 : right + 1 + left] = np.where(np.arange(left) < llen[:, None], s.buf[np.maximum(at, 0)], 0)
        rows[:, right + 1 + left] = llen
    return rows


def _used(rows_r: np.ndarray, rows_l: np.ndarray, length: int) -> np.ndarray:
    """Mask of the places that hold text."""
    right, width = _layout(length)
    place = np.arange(width)
    return (place < rows_r[:, None]) | ((place > right) & (place <= right + rows_l[:, None]))


def front_code(rows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(common prefix with the row before, both lengths, bytes beyond the common prefix)."""
    right, width = _layout(length)
    lcp = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = differ.argmax(1)
    rlen, llen = rows[:, right], rows[:, right + 1 + length - _GRAM]
    mask = _used(rlen, llen, length) & (np.arange(width) >= lcp[:, None])
    return lcp, rlen, llen, rows[mask]


def front_decode(lcp: np.ndarray, rlen: np.ndarray, llen: np.ndarray, tail: np.ndarray, length: int) -> np.ndarray:
    right, width = _layout(length)
    rows = np.zeros((len(lcp), width), np.uint8)
    used = _used(rlen, llen, length)
    own = np.arange(width) >= lcp[:, None]
    rows[used & own] = tail
    for j in range(int(lcp.max(initial=0))):
        source = np.maximum.accumulate(np.where(lcp <= j, np.arange(len(lcp)), 0))
        rows[:, j] = rows[source, j]
    rows[:, right], rows[:, right + 1 + length - _GRAM] = rlen, llen
    return rows


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows as 7-byte big-endian integers."""
    n, width = rows.shape
    wide = np.zeros((n, width // _STEP, 8), np.uint8)
    wide[:, :, 1:] = rows.reshape(n, width // _STEP, _STEP)
    return wide.reshape(n, -1).view(">u8").astype(np.int64)


def codes_of(words: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Offset-value code of each row of a run against the row before it, from their common prefix in bytes
    (nothing for the first); the rows of a run are distinct."""
    at = lcp.astype(np.int64) // _STEP
    return (words.shape[1] - at) << _TOP | words[np.arange(len(words)), at]


def loser_tree_merge(runs: list[np.ndarray], run_codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs of word rows with their codes: (run, place in it, common words with the output before).

    A tree node keeps the loser of its match with its code against the winner. The winner's successor
    carries its code against the winner, so all codes on its path share one base: different codes decide
    a match alone, and equal codes are compared from the word after the one they hold."""
    runs_n, arity = len(runs), runs[0].shape[1]
    size = 1
    while size < runs_n:
        size *= 2
    end = (arity + 1) << _TOP
    codes = [c.tolist() + [end] for c in run_codes] + [[end]] * (size - runs_n)
    pos = [0] * size
    now = [c[0] for c in codes]
    tree = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether run a goes before run b; the loser's code is set against the winner."""
        x, y = now[a], now[b]
        if x != y:
            return x < y
        if x == end or x == 0:
            return True
        wa, wb = runs[a][pos[a]], runs[b][pos[b]]
        for k in range(arity - (x >> _TOP) + 1, arity):
            p, q = int(wa[k]), int(wb[k])
            if p != q:
                if p < q:
                    now[b] = (arity - k) << _TOP | q
                    return True
                now[a] = (arity - k) << _TOP | p
                return False
        now[b] = 0
        return True

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        if beats(a, b):
            tree[node] = b
            return a
        tree[node] = a
        return b

    total = sum(len(r) for r in runs)
    out_run, out_code = [0] * total, [0] * total
    winner = build(1) if size > 1 else 0
    for n in range(total):
        out_run[n], out_code[n] = winner, now[winner]
        p = pos[winner] = pos[winner] + 1
        now[winner] = codes[winner][p]
        node = (winner + size) >> 1
        while node:
            other = tree[node]
            x, y = now[other], now[winner]
            if x < y or (x == y and x and x != end and not beats(winner, other)):
                tree[node], winner = winner, other
            node >>= 1
    run = np.array(out_run, np.int64)
    code = np.array(out_code, np.int64)
    order = np.argsort(run, kind="stable")
    place = np.empty(total, np.int64)
    counts = np.bincount(run, minlength=runs_n)
    place[order] = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return run, place, np.where(code == 0, arity, arity - (code >> _TOP))


def common_bytes(rows: np.ndarray, words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before, in bytes: ``common`` words are known to agree, so only
    the word after them is looked at."""
    n, arity = words.shape
    out = common * _STEP
    some = np.flatnonzero((common < arity) & (np.arange(n) > 0))
    at = common[some]
    differ = words[some, at] ^ words[some - 1, at]
    for byte in range(1, _STEP):
        out[some] += differ >> (8 * (_STEP - byte)) == 0
    return out


def interval_least(rows: np.ndarray, lcp: np.ndarray, group: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For merged distinct rows, their common prefixes and groups (rows with one anchor): the least id among all rows
    that hold the string, for each ``length``-byte string, in the order of the rows and of the strings in them."""
    right, _ = _layout(length)
    left = length - _GRAM
    rlen, llen = rows[:, right].astype(np.int64), rows[:, right + 1 + left].astype(np.int64)
    n = rlen + llen - length + 1
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    # the order of the backward prefixes, and the common prefix of neighbours in it
    back = np.ascontiguousarray(rows[:, right + 1 : right + 1 + left])
    by_back = np.argsort(back.view(f"S{left}").reshape(-1), kind="stable")
    by_back = by_back[np.argsort(group[by_back], kind="stable")]
    sorted_back, sorted_group = back[by_back], group[by_back]
    back_lcp = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = sorted_back[1:] != sorted_back[:-1]
        back_lcp[1:] = np.where(differ.any(1), differ.argmax(1), left)
        back_lcp[1:][sorted_group[1:] != sorted_group[:-1]] = -1
    for o in range(left + 1):
        rows_o = np.flatnonzero((llen >= o) & (rlen >= length - o))
        if not len(rows_o):
            continue
        forward = np.cumsum(lcp < length - o)
        backward = np.empty(len(rows), np.int64)
        backward[by_back] = np.cumsum(back_lcp < o)
        key = forward[rows_o] * (len(rows) + 1) + backward[rows_o]
        order, head, place = distinct(key.astype(np.uint64))
        ids, _ = least_ids(least[rows_o], order, head)
        out[first[rows_o] + llen[rows_o] - o] = ids[place]
    return out


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, chunk_bytes: int = 2_000_000, bucket_bytes: int = 3_000_000) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, kept (binary, the remaining bytes) and spans (removed
    byte ranges as start:end, comma-joined)."""
    if not _GRAM < length < 120:
        raise ValueError("length must lie between 15 and 119")
    plan = Plan(docs, id_col, text_col, chunk_bytes, bucket_bytes)
    buckets, prints = plan.buckets, Prints(plan.total, plan.buckets)

    def anchors(parts: list[_Slice]):
        f = prints.of(_cat([s.hash for s in parts], np.uint64))
        return f, *distinct(f)

    def send_anchors(docs: pa.Table) -> pa.Table:
        parts = _slices(docs, length)
        f, order, first, _ = anchors(parts)
        _, several = least_ids(_cat([s.owner for s in parts], np.int64), order, first)
        return blocks(prints.send(docs["chunk"][0].as_py(), f[order][first], several))

    def living(parts: list[_Slice], known: pa.Table) -> np.ndarray:
        *_, place = anchors(parts)
        return answers(known)[place] if len(place) else np.zeros(0, bool)

    def units(parts: list[_Slice], flags: np.ndarray):
        """(per slice its living units, bucket of each distinct unit, their rows, least ids, place of each unit)."""
        alive = np.split(flags, np.cumsum([len(s.anchor) for s in parts])[:-1]) if parts else []
        rows = np.concatenate([unit_rows(s, a, length) for s, a in zip(parts, alive, strict=True)]) if parts else np.zeros((0, _layout(length)[1]), np.uint8)
        bucket = K.bucket_of(_cat([s.hash[a] for s, a in zip(parts, alive, strict=True)], np.uint64), buckets)
        ids = _cat([s.owner[a] for s, a in zip(parts, alive, strict=True)], np.int64)
        order = np.argsort(rows.view(f"S{rows.shape[1]}").reshape(-1), kind="stable") if len(rows) else np.zeros(0, np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        rows, bucket = rows[order], bucket[order]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))) if len(rows) else np.zeros(0, bool)
        unit = np.empty(len(order), np.int64)
        unit[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(rows) else ids
        return alive, bucket[new], rows[new], least, unit

    def send_units(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return blocks([])
        parts = _slices(docs, length)
        flags = living(parts, known)
        _, bucket, rows, least, _ = units(parts, flags)
        chunk = docs["chunk"][0].as_py()
        return blocks([note(chunk, flags), *((b, chunk, K.pack(*front_code(rows[x:y], length), least[x:y])) for b, x, y in split_sorted(bucket))])

    def resolve_units(table: pa.Table) -> pa.Table:
        bucket, chunks = table["bucket"][0].as_py(), table["chunk"].to_pylist()
        if bucket < 0:
            return table.select(["bucket", "chunk", "payload"])
        rows, least, codes, words = [], [], [], []
        for p in table["payload"].to_pylist():
            lcp, rlen, llen, tail, ids = K.unpack(p)
            rows.append(front_decode(lcp, rlen, llen, tail, length))
            words.append(_words(rows[-1]))
            codes.append(codes_of(words[-1], lcp))
            least.append(ids)
        run, place, common = loser_tree_merge(words, codes)
        sizes = np.array([len(r) for r in rows])
        every, ids = np.concatenate(rows), np.concatenate(least)
        at = (np.cumsum(sizes) - sizes)[run] + place
        arity = every.shape[1] // _STEP
        unit = np.cumsum(common < arity) - 1
        heads = np.flatnonzero(common < arity)
        merged, unit_least = every[at[heads]], np.minimum.reduceat(ids[at], heads)
        lcp = common_bytes(merged, np.concatenate(words)[at[heads]], common[heads])
        group = np.cumsum(lcp < _GRAM) - 1
        right, left = length, length - _GRAM
        n = merged[:, right].astype(np.int64) + merged[:, right + 1 + left] - length + 1
        # for each string of a unit, the least id that has it: the unit's own where no other has its anchor
        first = np.cumsum(n) - n
        string_least = np.repeat(unit_least, n)
        mixed = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(mixed):
            m = n[mixed]
            found = interval_least(merged[mixed], lcp[mixed], group[mixed], unit_least[mixed], length)
            string_least[np.repeat(first[mixed] - (np.cumsum(m) - m), m) + np.arange(m.sum())] = found
        mine = np.empty(len(every), np.int64)
        mine[at] = unit
        count = n[mine]
        spot = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        bits = string_least[spot] < np.repeat(ids, count)
        ends = np.cumsum(count)[np.cumsum(sizes) - 1]
        begins = np.concatenate(([0], ends[:-1]))
        return blocks([(bucket, c, pack_bits(bits[x:y])) for c, x, y in zip(chunks, begins.tolist(), ends.tolist(), strict=True)])

    def apply(docs: pa.Table, known: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        texts = pc.fill_null(docs["text"], "")
        n_bytes = pc.binary_length(texts).cast(pa.int64())
        removed, kept, spans = [], [], []
        if docs.num_rows:
            parts = _slices(docs, length)
            alive, _, rows, least, unit = units(parts, notes(known))
            bits, done = answers(known), 0
            right, left = length, length - _GRAM
            size = rows[:, right].astype(np.int64) + rows[:, right + 1 + left] - length + 1
            begin = np.cumsum(size) - size
            for s, a in zip(parts, alive, strict=True):
                first, count, owner = s.first[a], s.count[a], s.owner[a]
                mine = unit[done : done + len(first)]
                done += len(first)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                hit = bits[np.repeat(begin[mine], count) + step] | np.repeat(owner > least[mine], count)
                at = np.sort((np.repeat(first, count) + step)[hit])
                edge = np.zeros(len(s.buf) + 1, np.int32)
                x, y = K.merged_runs(at, at + length)
                edge[x] += 1
                edge[y] -= 1
                gone = np.cumsum(edge[:-1]).astype(bool)
                # runs per text: touching runs of two texts are cut at the text's end
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                cut = s.offs[:-1][s.offs[:-1] < len(gone)]
                start[cut] = gone[cut]
                stop = gone.copy()
                stop[:-1] &= ~gone[1:]
                cut = s.offs[1:][s.offs[1:] > 0] - 1
                stop[cut] = gone[cut]
                runs = np.column_stack((np.flatnonzero(start), np.flatnonzero(stop) + 1))
                bound = np.searchsorted(runs[:, 0], s.offs)
                for r in range(len(s.offs) - 1):
                    p, q = int(s.offs[r]), int(s.offs[r + 1])
                    own = runs[bound[r] : bound[r + 1]] - p
                    removed.append(int((own[:, 1] - own[:, 0]).sum()))
                    kept.append(s.buf[p:q][~gone[p:q]].tobytes() if len(own) else s.buf[p:q].tobytes())
                    spans.append(",".join(f"{u}:{v}" for u, v in own.tolist()))
        cols = [docs["doc_id"].cast(pa.int64()), n_bytes, pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.string())]
        return pa.table(cols, names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    first = plan.ask(send_anchors, prints.resolve, None)
    second = plan.ask(send_units, resolve_units, first)
    return plan.finish(apply, second, "doc_id long, n_bytes long, n_removed long, kept binary, spans string")
