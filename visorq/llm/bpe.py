"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes sets chunk boundaries, so that documents which share a passage share its
chunks. Each chunk is encoded by itself, once per worker while its bounded cache holds it. The joins are then
repaired by re-encoding. Byte-level files split a text into words before they merge, so a join agrees by itself
only where the split surely cuts: between two characters that no alternative of the split expression takes
together, whatever stands around them (``sure_cuts``). At any other join the text is encoded again from the last such
place before it to the first behind it, over as many chunks as that takes; there both neighbours have a word's
end, so they agree with the new encoding exactly.

Files without a pre-tokenizer merge over the whole text. For them a row of tokens is the encoding of its text
exactly if each two neighbours are the encoding of theirs; at a join the two are encoded together, and where that
gives other tokens, ever more text around it, until the first and the last new token agree with their outer neighbours.
Files with a normalizer or another pre-tokenizer, and texts that hold one of the file's added tokens, are encoded at once.

Defined cases: null text counts as empty (no ids, empty decoded text); added tokens in a text are
encoded as the tokenizer file says; repeated rows are returned one by one; a null id is returned as
null; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernel import SLICE, U, gram_hash, slices, text_buffer, trim

_TOKENIZERS: dict = {}
_GRAM = 16


#: Fixed value: the expression by which byte-level BPE splits text.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _rank_encoder(tok):
    """A faster encoder with the file's own vocabulary, for plain Latin pieces; None if the file isn't
    byte-level BPE whose ids follow its merges."""
    import json

    import tiktoken

    spec = json.loads(tok.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or spec["normalizer"]:
        return None
    merged = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
    if any(model["vocab"].get(x.replace(" ", "")) != 256 + i for i, x in enumerate(merged)):
        return None
    special = {x["content"] for x in spec["added_tokens"]}
    ranks = {_from_byte_level(t): i for t, i in model["vocab"].items() if t not in special}
    enc = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda piece: enc.encode_ordinary(piece.decode()) if _PLAIN(piece) else None


def _token_bytes(tok) -> list[bytes] | None:
    """The bytes of each id, if the file is one whose joins can be compared; else None."""
    import json

    spec = json.loads(tok.to_str())
    model, pre, decoder = spec["model"], spec["pre_tokenizer"], spec["decoder"]
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or spec["normalizer"] or any(model.get(k) for k in odd):
        return None
    if pre is None:
        text = str.encode
    elif pre["type"] == "ByteLevel" and not pre.get("add_prefix_space") and decoder and decoder["type"] == "ByteLevel":
        text = _from_byte_level
    else:
        return None
    table = [b""] * (max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])], default=-1) + 1)
    added = {x["id"] for x in spec["added_tokens"]}
    for t, i in model["vocab"].items():
        if i not in added:
            table[i] = text(t)
    return table


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level files write bytes."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}


_LETTERS = _byte_letters()


def _from_byte_level(token: str) -> bytes:
    return bytes(_LETTERS[c] for c in token)


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t, _rank_encoder(t), _token_bytes(t)
    return _TOKENIZERS[path]


def cut_places(buf: np.ndarray, offs: np.ndarray, mean: int) -> np.ndarray:
    """Sorted places at which the texts are cut: text ends, and where the hash of the bytes before says so.
    It says so more often before a space, where joins mostly agree at once; never inside a character."""
    n = len(buf)
    edges = offs[np.concatenate(([True], offs[1:] != offs[:-1]))]
    cut = np.zeros(n + 1, bool)
    cut[edges] = True
    if n > _GRAM:
        h = gram_hash(buf, _GRAM)[:-1] >> U(20)
        here = buf[_GRAM:]
        # about one byte in six of a text is a space
        cut[_GRAM:n] |= (here == 32) & (h % U(max(1, mean // 6)) == U(0)) | ((here & 0xC0) != 0x80) & (h % U(8 * mean) == U(1))
    return np.flatnonzero(cut)


#: Kinds of bytes: letters, digits and punctuation of ASCII without the apostrophe, which may begin a contraction;
#: white space; everything else.
_OTHER, _LETTER, _DIGIT, _PUNCT, _SPACE = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _PUNCT
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[39] = _OTHER
_KIND[[32, 9, 10, 11, 12, 13]] = _SPACE


def sure_cuts(buf: np.ndarray) -> np.ndarray:
    """For each byte, whether the split of byte-level BPE surely cuts before it.

    It does between unlike ones of letters, digits and punctuation, as each of its words but a contraction holds one
    of the three kinds, and before white space that follows none, as spaces only stand first in a word. Characters
    beyond ASCII count as no white space where their first byte rules that out."""
    kind, out = _KIND[buf], np.zeros(len(buf), bool)
    if len(buf) < 2:
        return out
    left, right = kind[:-1], kind[1:]
    word = (left != _OTHER) & (left != _SPACE)
    out[1:] = word & (right != _OTHER) & (left != right)
    for n, low, high in ((2, 0xC3, 0xDF), (3, 0xE4, 0xEF), (4, 0xF0, 0xF4)):
        if len(buf) > n:  # a whole character of n bytes before white space
            inner = np.ones(len(buf) - n, bool)
            for k in range(1, n):
                inner &= (buf[k : len(buf) - n + k] & 0xC0) == 0x80
            out[n:] |= (kind[n:] == _SPACE) & inner & (buf[:-n] >= low) & (buf[:-n] <= high)
    return out


#: Text of which both encoders hold the same view: ASCII and Latin letters of two bytes.
_PLAIN = re.compile(rb"(?:[\n\x20-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])*+").fullmatch


class ChunkCache:
    """Encodings of chunks, each computed once while it is kept, and which pairs of tokens stay as they are.

    Two generations: when the young one holds ``most`` bytes it becomes the old one, and what is used
    again moves on, so memory stays bounded and shared chunks stay.
    """

    def __init__(self, path: str, most: int):
        self.most = most
        self.tok, self.fast, self.table = _tokenizer(path)
        self.added = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]
        self.chunks, self.old_chunks, self.size = {}, {}, 0
        self.pairs: dict[tuple[int, int], bool] = {}
        self.splits = self.tok.pre_tokenizer is not None
        self.sizes = np.array([len(t) for t in self.table], np.int64) if self.table is not None else None

    def encode(self, chunks: list[bytes]) -> dict[bytes, array | None]:
        """The ids of each chunk by itself; None where they don't hold the chunk's bytes."""
        out, new = {}, []
        for c in dict.fromkeys(chunks):
            x = self.chunks.get(c)
            if x is None and (x := self.old_chunks.get(c)) is not None:
                self._keep(c, x)
            if x is None and self.fast and (x := self.fast(c)) is not None:
                x = array("I", x)
                self._keep(c, x)
            if x is None:
                new.append(c)
            else:
                out[c] = x
        if new:
            for c, e in zip(new, self.tok.encode_batch_fast([c.decode() for c in new], add_special_tokens=False), strict=True):
                # a file that has no token for some character drops it or writes another: no joins then
                out[c] = array("I", e.ids) if b"".join([self.table[t] for t in e.ids]) == c else None
                if out[c] is not None:
                    self._keep(c, out[c])
        return out

    def _keep(self, chunk: bytes, x: array) -> None:
        if self.size > self.most:
            self.old_chunks, self.chunks, self.size = self.chunks, {}, 0
        self.chunks[chunk] = x
        self.size += 250 + len(chunk) + 4 * len(x)

    def _ids(self, piece: bytes) -> list[int]:
        x = self.fast(piece) if self.fast else None
        return x if x is not None else self.tok.encode(piece.decode(), add_special_tokens=False).ids

    def stays(self, a: int, b: int) -> bool:
        """Whether the two tokens' text is encoded as these two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            piece = self.table[a] + self.table[b]
            try:
                known = self._ids(piece) == [a, b]
            except UnicodeDecodeError:  # cut inside a character: not decided by these two
                known = False
            if len(self.pairs) > 100_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def assemble(self, raw: bytes, places: list[int], chunks: list[array], sure: np.ndarray) -> array | None:
        """The ids of the text between the first and the last of ``places``, from those of its chunks. sure: the sorted
        places where the split surely cuts. None if a chunk has no token's end where it should have one."""
        first, last, again = places[0], places[-1], []
        at = np.searchsorted(sure, places[1:-1])
        for p, k in zip(places[1:-1], at.tolist(), strict=True):
            if k < len(sure) and sure[k] == p:
                continue
            low = max(first, int(sure[k - 1]) if k else first)
            if not again or again[-1][0] != low:
                again.append((low, min(last, int(sure[k]) if k < len(sure) else last)))
        if not again:
            out = array("I")
            for x in chunks:
                out.extend(x)
            return out
        out, done, i = array("I"), first, 0

        def take(end: int) -> bool:
            """Append the chunks' tokens from ``done`` to ``end``."""
            nonlocal done, i
            while done < end:
                while places[i + 1] <= done:
                    i += 1
                upto = min(end, places[i + 1])
                if done == places[i] and upto == places[i + 1]:
                    out.extend(chunks[i])
                else:
                    ends = np.concatenate(([0], np.cumsum(self.sizes[chunks[i]]))) + places[i]
                    x, y = np.searchsorted(ends, [done, upto]).tolist()
                    if ends[x] != done or ends[y] != upto:
                        return False
                    out.extend(chunks[i][x:y])
                done = upto
            return True

        for low, high in again:
            if not take(low):
                return None
            out.extend(array("I", self._ids(raw[low:high])))
            done = high
        return out if take(last) else None

    def join(self, left: array, right: array) -> None:
        """Append ``right`` to ``left`` and encode the text around the join until both sides agree."""
        if not left or not right or self.stays(left[-1], right[0]):
            left.extend(right)
            return
        n = 2
        while True:
            i, j = max(len(left) - n, 0), min(n, len(right))
            try:
                ids = self._ids(b"".join([self.table[t] for t in left[i:]] + [self.table[t] for t in right[:j]]))
            except UnicodeDecodeError:
                ids = None
            if ids and (not i or self.stays(left[i - 1], ids[0])) and (j == len(right) or self.stays(ids[-1], right[j])):
                del left[i:]
                left.extend(ids)
                left.extend(right[j:])
                return
            n *= 2

    def whole(self, text: bytes) -> tuple[bytes, str]:
        """(ids as bytes, decoded text) of a text that is encoded at once."""
        ids = self.tok.encode(text.decode(), add_special_tokens=False).ids
        return array("I", ids).tobytes(), self.tok.decode(ids, skip_special_tokens=False)

    def decode(self, ids: array) -> str:
        if self.tok.pre_tokenizer is None:
            return self.tok.decode(list(ids), skip_special_tokens=False)
        return b"".join([self.table[t] for t in ids]).decode("utf-8", "replace")  # byte-level decoding


def encode_texts(col: pa.Array, cache: ChunkCache, mean: int) -> Iterator[tuple[int, bytes, str]]:
    """(row, ids as little-endian 32-bit integers, decoded text) of each text."""
    buf, offs = text_buffer(col)
    for first, last, part, at in slices(buf, offs, SLICE):
        raw = part.tobytes()
        texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        at_once = [cache.table is None or any(x in t for x in cache.added) for t in texts]
        if all(at_once):
            yield from ((first + r, *cache.whole(t)) for r, t in enumerate(texts))
            continue
        cuts = cut_places(part, at, mean)
        sure = np.flatnonzero(sure_cuts(part)) if cache.splits else None
        ends = np.searchsorted(cuts, at).tolist()
        places = cuts.tolist()
        chunks = [raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        known = cache.encode([c for r, skip in enumerate(at_once) if not skip for c in chunks[ends[r] : ends[r + 1]]])
        for row in range(first, last):
            r = row - first
            if at_once[r]:
                yield row, *cache.whole(texts[r])
                continue
            ids, mine = array("I"), [known[c] for c in chunks[ends[r] : ends[r + 1]]]
            if any(x is None for x in mine):
                yield row, *cache.whole(texts[r])
                continue
            if cache.splits:
                ids = cache.assemble(raw, places[ends[r] : ends[r + 1] + 1], mine, sure) if mine else ids
                if ids is None:
                    yield row, *cache.whole(texts[r])
                    continue
            else:
                for x in mine:
                    cache.join(ids, x)
            yield row, ids.tobytes(), cache.decode(ids)


_CACHES: dict = {}


def _cache(path: str, most: int) -> ChunkCache:
    """One cache per worker process, kept between its tasks."""
    if (path, most) not in _CACHES:
        _CACHES[path, most] = ChunkCache(path, most)
    return _CACHES[path, most]


def bpe(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 512, cache_bytes: int = 24_000_000) -> DataFrame:
    """Per document: doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (string).

    chunk_bytes: about a chunk's length; cache_bytes: of the chunks that a worker keeps (twice that at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer_path, cache_bytes)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
        for batch in batches:
            doc_ids, rows, size = batch.column(0), [], 0
            start = 0
            for row, ids, text in encode_texts(batch.column(1), cache, chunk_bytes):
                rows.append((ids, text))
                size += len(ids) + len(text)
                if size > 4_000_000 or row == batch.num_rows - 1:
                    yield pa.record_batch([doc_ids.slice(start, len(rows)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], schema=schema)
                    start, rows, size = row + 1, [], 0
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
