"""Benchmark decontamination with a distributed positional inverted index.

The index holds every token of the training texts: a row per shard and term with the term's list of places,
delta-coded. A shard is a run of whole documents of bounded size, so a frequent term weighs on no single
task; places of two documents lie further apart than any match reaches. The index is stored once, whatever
the benchmark's size.

The benchmark's windows are a table as well. Term frequencies over the whole index put each window's terms
in the order of rarity. The windows are joined by their rarest term with the index rows of that term, which
names the shards that can hold them, and meet there the posting lists of the benchmark's terms: the rarest
term's places, less its offset in the window, are the candidates, and they are intersected with the
offset-adjusted lists of the other terms from the rarest on. What agrees in all terms is an exact phrase
match; what agrees within ``slop`` places per term is a proximity match. Windows go in blocks of bounded
size, so that a task holds one shard's lists and one block; nothing is broadcast or sent to the driver.

Defined cases: null or empty texts have no words and no hits; items without words have no windows; items
with a null id mark words but are not listed; rows sharing an item id are one item; repeated document
rows are returned one by one; an empty table gives an empty result, an empty benchmark no hits; other
input columns are not read, but those named in ``carry`` are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import discard, materialize

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes after lower-casing: digits, a-z and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_rows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row of each word)."""
    buf = _LOWER[buf]
    starts, ends, rows = K.spans(buf, offs, _WORD)
    return K.span_hash(buf, starts, ends), rows


def sliced_word_rows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_rows``, a part of the texts at a time: hashing takes some 40 bytes per byte of text."""
    words, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, _, part, at in K.slices(buf, offs, K.SLICE):
        w, r = word_rows(part, at)
        words.append(w)
        rows.append(r + i)
    return np.concatenate(words), np.concatenate(rows)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, terms): the windows of each item, as term hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.text_buffer(batch.column(1))
            for i, j, part, at in K.slices(buf, offs, K.SLICE):
                words, rows = word_rows(part, at)
                n = np.bincount(rows, minlength=j - i)
                size = np.minimum(n, window)
                count = np.where(n > 0, n - size + 1, 0)
                owner = np.repeat(np.arange(j - i), count)
                first = np.repeat(np.cumsum(n) - n, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                length = size[owner]
                at_term = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(words[at_term].view(np.int64)))
                yield pa.record_batch([batch.column(0).take(pa.array(owner + i)), lists], names=["item", "terms"])

    return benchmark.mapInArrow(run, "item string, terms array<long>")


#: Partitions whose rows (2^40 each) and shards (2^24 each) have numbers of their own.
_TASKS = 1 << 23


def build_index(docs: DataFrame, gap: int, shard_bytes: int) -> DataFrame:
    """The stored index. Rows with a term: shard, term, n and places (the term's places in the shard, as
    32-bit differences). Rows without: rid (a number of the row), the columns of ``docs`` but its last,
    the text, n_words and base, the place of its first word in the shard."""
    kept = docs.columns[:-1]
    types = _fields(docs.select(*kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        if task >= _TASKS:
            raise ValueError(f"at most {_TASKS} partitions can be numbered")
        shard, row = task << 24, task << 40
        schema = None
        for batch in batches:
            buf, offs = K.text_buffer(batch.column(len(kept)))
            for i, j, part, at in K.slices(buf, offs, shard_bytes):
                words, rows = sliced_word_rows(part, at)
                n = np.bincount(rows, minlength=j - i)
                base = np.cumsum(n + gap) - (n + gap)
                place = np.arange(len(words)) - (np.cumsum(n) - n)[rows] + base[rows]
                order = np.argsort(words, kind="stable")
                term, place = words[order], place[order]
                new = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else np.zeros(0, bool)
                head = np.flatnonzero(new)
                delta = np.diff(place, prepend=0)
                delta[head] = place[head]
                count = np.diff(np.append(head, len(term)))
                offsets = pa.py_buffer(np.concatenate(([0], np.cumsum(count * 4))).astype(np.int32).tobytes())
                places = pa.Array.from_buffers(pa.binary(), len(head), [None, offsets, pa.py_buffer(delta.astype("<u4").tobytes())])
                n_post, n_docs = len(head), j - i
                none = lambda k, t: pa.nulls(k, t)
                cols = {
                    "shard": (pa.array(np.full(n_post, shard)), pa.array(np.full(n_docs, shard))),
                    "term": (pa.array(term[head].view(np.int64)), none(n_docs, pa.int64())),
                    "n": (pa.array(count.astype(np.int64)), none(n_docs, pa.int64())),
                    "places": (places, none(n_docs, pa.binary())),
                    "rid": (none(n_post, pa.int64()), pa.array(row + np.arange(n_docs))),
                } | {c: (none(n_post, x.type), x.slice(i, n_docs)) for c, x in zip(kept, batch.columns, strict=False)} | {
                    "n_words": (none(n_post, pa.int64()), pa.array(n.astype(np.int64))),
                    "base": (none(n_post, pa.int64()), pa.array(base.astype(np.int64))),
                }
                schema = schema or pa.schema([(c, x[0].type) for c, x in cols.items()])
                for side in range(2):
                    yield pa.record_batch([x[side] for x in cols.values()], schema=schema)
                shard, row = shard + 1, row + n_docs
                if shard >> 24 != task or row >> 40 != task:
                    raise ValueError("a partition is too large to be numbered")
        K.trim()

    return materialize(docs.mapInArrow(run, f"shard long, term long, n long, places binary, rid long, {types}, n_words long, base long"), "postings")


class Lists:
    """The posting lists of one shard: all places, in the order of terms, as one sorted array."""

    def __init__(self, terms: np.ndarray, places: pa.Array):
        offs = np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + len(places) + 1] // 4
        data = places.buffers()[2]
        delta = np.frombuffer(data, "<u4")[offs[0] : offs[-1]].astype(np.int64) if data is not None and len(places) else np.zeros(0, np.int64)
        offs = (offs - offs[0]).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(delta)))
        count = np.diff(offs)
        place = total[1:] - np.repeat(total[offs[:-1]], count)
        order = np.argsort(terms)
        self.terms = terms[order]
        self.count = count[order]
        self.first = np.cumsum(self.count) - self.count
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        self.keys = np.sort(np.repeat(rank, count) << 32 | place)

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Each term's number here, -1 if the shard doesn't have it."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def near(self, rank: np.ndarray, place: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the term of that rank is within ``slop`` of the place, and whether it is right there."""
        key = rank << 32 | place
        low = np.searchsorted(self.keys, np.maximum(key - slop, rank << 32))
        found = self.keys[np.minimum(low, len(self.keys) - 1)]
        some = (found <= key + slop) & (found >> 32 == rank) & (low < len(self.keys))
        exact = np.searchsorted(self.keys, key)
        return some, self.keys[np.minimum(exact, len(self.keys) - 1)] == key


#: Candidates, places of rarest terms, that are intersected at a time.
_CANDIDATES = 200_000


def intersect_all(lists: Lists, ranks: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``intersect``, some windows at a time, so that the candidates held stay few."""
    before = np.concatenate(([0], np.cumsum(lists.count[ranks[:, 0]])))
    found, a = [], 0
    while a < len(ranks):
        b = max(a + 1, int(np.searchsorted(before, before[a] + _CANDIDATES, "right")) - 1)
        w, start, exact = intersect(lists, ranks[a:b], offsets[a:b], sizes[a:b], slop)
        found.append((w + a, start, exact))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def intersect(lists: Lists, ranks: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact) of the proximity matches. ranks, offsets: per window its terms from the rarest
    on, and their offsets, padded to a rectangle; sizes: how many there are."""
    rare = ranks[:, 0]
    n = lists.count[rare]
    w = np.repeat(np.arange(len(ranks)), n)
    posting = np.repeat(lists.first[rare] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    start = (lists.keys[posting] & 0xFFFFFFFF) - offsets[w, 0]
    w, start = w[start >= 0], start[start >= 0]
    exact = np.ones(len(w), bool)
    for k in range(1, ranks.shape[1]):
        if not len(w):
            break
        has = sizes[w] > k
        near, same = np.ones(len(w), bool), np.ones(len(w), bool)
        near[has], same[has] = lists.near(ranks[w[has], k], start[has] + offsets[w[has], k], slop)
        w, start, exact = w[near], start[near], (exact & same)[near]
    return w, start, exact


_MATCHES = "rid long, hits array<long>, exact array<long>, near array<long>"


def _match_shard(windows: pa.Table, index: pa.Table, slop: int) -> pa.Table:
    """The documents of a shard that a block's windows match: merged hits (start, end, ...) and window numbers."""
    import pyarrow.compute as pc

    out: dict[str, list] = {"rid": [], "hits": [], "exact": [], "near": []}
    if windows.num_rows and index.num_rows:
        docs = index.filter(pc.is_valid(index["rid"])).sort_by("base")
        posts = index.filter(pc.is_valid(index["term"]))
        lists = Lists(posts["term"].to_numpy(), posts["places"].combine_chunks() if posts["places"].num_chunks != 1 else posts["places"].chunk(0))
        terms, order = windows["terms"].combine_chunks(), windows["offsets"].combine_chunks()
        terms, order = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, order))
        sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        flat = lists.ranks(terms.flatten().to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ranks, offsets = np.full((len(sizes), sizes.max()), -1), np.zeros((len(sizes), sizes.max()), np.int64)
        ranks[row, col], offsets[row, col] = flat, order.flatten().to_numpy()
        here = np.bincount(row[flat >= 0], minlength=len(sizes)) == sizes
        wid, ranks, offsets, sizes = windows["wid"].to_numpy()[here], ranks[here], offsets[here], sizes[here]
        if len(wid):
            w, start, exact = intersect_all(lists, ranks, offsets, sizes, slop)
            base = docs["base"].to_numpy()
            owner = np.searchsorted(base, start, "right") - 1
            # a proximity match may begin before its first document or end behind the last word
            inside = (owner >= 0) & (start + sizes[w] <= base[owner] + docs["n_words"].to_numpy()[owner])
            by = np.lexsort((start[inside], owner[inside]))
            w, start, exact, owner = (x[inside][by] for x in (w, start, exact, owner))
            rids = docs["rid"].to_numpy()
            for x, y in K.equal_runs(owner):
                own, full = owner[x], exact[x:y]
                s = start[x:y][full] - base[own]
                a, b = K.merged_runs(s, s + sizes[w[x:y][full]])
                out["rid"].append(int(rids[own]))
                out["hits"].append(np.column_stack((a, b)).reshape(-1).tolist())
                out["exact"].append(np.unique(wid[w[x:y][full]]).tolist())
                out["near"].append(np.unique(wid[w[x:y]]).tolist())
    K.trim()
    return pa.table([pa.array(out["rid"], pa.int64()), *(pa.array(out[c], pa.list_(pa.int64())) for c in ("hits", "exact", "near"))], names=list(out))


def find_matches(index: DataFrame, windows: DataFrame, slop: int, block_windows: int) -> DataFrame:
    """Stored (rid, hits, exact, near) per matched document and block of windows. windows: wid, terms."""
    blocks = max(1, -(-windows.count() // block_windows))
    posts = index.filter("term is not null")
    each = windows.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("k", "term"))
    vocabulary = each.select("term").distinct()
    freq = posts.select("term", "n").join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("freq"))
    plan = each.join(freq, "term").groupBy("wid", "size").agg(F.sort_array(F.collect_list(F.struct("freq", "k", "term"))).alias("plan")).filter("size(plan) = size")
    plan = plan.select("wid", F.col("plan.term").alias("terms"), F.col("plan.k").cast("array<long>").alias("offsets"), F.get("plan.term", F.lit(0)).alias("term"))
    plan = materialize(plan.withColumn("block", F.pmod(F.xxhash64("wid"), F.lit(blocks)).cast("int")), "window-plans")
    asked = materialize(posts.select("shard", "term").join(plan, "term").select("shard", "block", "wid", "terms", "offsets"), "asked")
    docs_of = index.filter("term is null").select("shard", "term", "places", "rid", "base", "n_words")
    if blocks == 1:
        lists = posts.join(plan.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").select("shard", "term", "places", "rid", "base", "n_words")
        held = lists.unionAll(docs_of).join(asked.select("shard").distinct(), "shard", "left_semi").withColumn("block", F.lit(0))
    else:  # a block gets the lists of its own windows' terms, from the shards that have some of these windows
        pair = asked.select("shard", F.col("block").alias("of_block"), "terms")
        terms = pair.select("shard", "of_block", F.explode("terms").alias("term")).distinct()
        lists = posts.join(terms, ["shard", "term"]).select("shard", "term", "places", "rid", "base", "n_words", "of_block")
        held = lists.unionAll(docs_of.join(pair.select("shard", "of_block").distinct(), "shard")).withColumnRenamed("of_block", "block")
    match = lambda w, i: _match_shard(w, i, slop)
    found = materialize(asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(match, _MATCHES), "matches")
    discard(plan, asked)
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, slop: int = 2, block_windows: int = 200_000, shard_bytes: int = 4_000_000, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, the columns named in ``carry``, n_words, n_hit (words inside exact matches),
    items (sorted ids with exact matches) and near_items (with proximity matches)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    named = materialize(benchmark_windows(bench, window).distinct(), "item-windows")
    windows = materialize(named.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    owners = materialize(named.filter("item is not null").join(windows, "terms").select("wid", "item"), "owners")
    index = build_index(docs, window + 2 * slop, shard_bytes)
    found = find_matches(index, windows, slop, block_windows)

    def listed(kind: str, name: str) -> DataFrame:
        pairs = found.select("rid", F.explode(kind).alias("wid")).join(owners, "wid").select("rid", "item").distinct()
        return pairs.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias(name))

    spans = found.groupBy("rid").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    runs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.struct(F.get("hits", i).alias("a"), F.get("hits", i + 1).alias("b"))))
    covered = F.aggregate(
        runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["to"], x["a"]))).cast("long").alias("n"), F.greatest(acc["to"], x["b"]).alias("to")),
        lambda acc: acc["n"],
    )
    matched = spans.select("rid", F.when(F.size("hits") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_hit"))
    matched = materialize(matched.join(listed("exact", "items"), "rid", "left").join(listed("near", "near_items"), "rid", "left"), "matched")
    none = F.array().cast("array<string>")
    out = materialize(index.filter("rid is not null").select("rid", "doc_id", *carry, "n_words").join(matched, "rid", "left").select(
        "doc_id", *carry, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    ), "contamination")
    discard(named, windows, owners, index, found, matched)
    return out
