"""Vectorised NumPy kernels over UTF-8 text: words, rolling hashes, anchors, packed columns.

All hashes are 64-bit polynomial hashes with a random byte table and a final mixer, computed from
prefix sums, so that every window of a slice costs a few array operations and no Python loop.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64
#: Bytes of text that are worked on at a time: arrays over them take some 50 to 100 times that.
SLICE = 250_000
_BASE, _WBASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
BYTE_HASH = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
#: For second hashes, where two together tell contents apart.
_BASE2, BYTE_HASH2 = 0xA24BAED4963EE407, np.random.default_rng(20250311).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        inverse = pow(base, -1, 2**64)
        size = max(n, 1 << 16)
        out = []
        for b in (base, inverse):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[base] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def mix32(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers."""
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def trim() -> None:
    """Give memory that is free back to the system, at the end of a task: the worker lives on, idle, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col, "")
    large = pa.types.is_large_string(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(buf: np.ndarray, offs: np.ndarray, most: int = 2_000_000):
    """(first row, last row, bytes, offsets) in runs of whole texts of about ``most`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def byte_set(spec: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(spec)] = False
    return out


#: Word bytes: everything but space and \t to \r.
WORDS = byte_set(b" \t\n\x0b\x0c\r")


def spans(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of word bytes, none across two rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = word[buf]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edges = offs[np.concatenate(([True], offs[1:] != offs[:-1]))]
    heads, tails = edges[edges < len(buf)], edges[edges > 0] - 1
    first[heads] = is_word[heads]
    last[tails] = is_word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def prefix_hash(buf: np.ndarray, second: bool = False) -> np.ndarray:
    p, _ = powers(_BASE2 if second else _BASE, len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((BYTE_HASH2 if second else BYTE_HASH)[buf] * p, out=out[1:])
    return out


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of each byte span; equal bytes have equal hashes at any place. second: another, independent hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(buf, second)
    _, inverse = powers(_BASE2 if second else _BASE, len(buf))
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64))


def gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes that start at each position (rows are not looked at)."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(buf)
    h = prefix[k:] - prefix[:-k]
    h *= powers(_BASE, len(buf))[1][:n]
    return mix64(h)


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes that start at each word (rows are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(_WBASE, len(words))
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p, out=prefix[1:])
    return mix64((prefix[k:] - prefix[:-k]) * inverse[:n] + U(k))


def row_end(offs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return offs[rows + 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    size, cur = 1, x
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[: len(x) - w + 1], cur[w - size : w - size + len(x) - w + 1]) if size < w else cur


def anchor_units(grams: np.ndarray, ends: np.ndarray, n: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group the windows of a sequence by their anchor.

    grams: hash of the k items at each place; ends: for each place, where its row ends; n: items.
    A window of ``window`` items has as anchor its gram of least hash, the leftmost of equals, which
    its content alone decides. Consecutive windows with one anchor make a unit.
    Returns (anchor place, first window, number of windows) of the units.
    """
    w = window - k + 1
    if len(grams) < w:
        z = np.zeros(0, np.int64)
        return z, z, z
    bits = U(max(20, int(n).bit_length()))
    keyed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keyed, w)
    at = (least & U((1 << int(bits)) - 1)).astype(np.int64)
    places = np.arange(len(at))
    good = places + window <= ends[: len(at)]
    places, at = places[good], at[good]
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[cut], places[cut], np.diff(np.append(cut, len(at)))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the hash, so that sorted hashes have contiguous buckets."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


_PACK = zstandard.ZstdCompressor(level=3)
_UNPACK = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little"))
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 and len(a) else a.tobytes())
    return _PACK.compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = memoryview(_UNPACK.decompress(data)), 1, []
    for _ in range(raw[0]):
        kind, n = np.dtype(bytes(raw[at : at + 4]).strip().decode()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        flat = np.frombuffer(raw[at : at + n * kind.itemsize], np.uint8)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).reshape(n) if kind.itemsize > 1 and n else flat.view(kind))
        at += n * kind.itemsize
    return out


def distinct_in_rows(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): each row's distinct values, sorted; rows are h[bounds[r]:bounds[r + 1]]. Sorts ``h``."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = h[1:] != h[:-1]
        new[bounds[:-1][bounds[:-1] < len(h)]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return h[new], kept[bounds]


def equal_runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal neighbours."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return list(zip(cut.tolist(), np.append(cut[1:], len(x)).tolist(), strict=True))


def ids_of(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer ids; null counts as the largest, so that it never precedes another."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return pc.fill_null(col.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def merged_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals that are sorted by start; touching ones become one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    cut = np.flatnonzero(new)
    return starts[cut], reach[np.append(cut[1:], len(starts)) - 1]


def first_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct pair (a, b)."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order[new]
