"""Linking the members of hash buckets: exact verification and distributed union-find, with no pairs of
a whole bucket.

Each bucket is named by its least member, its hub; a member of several buckets with one hub is one row.
Any two members of a bucket thus meet in the hub's group, and each group is linked exactly:

A group of bounded size goes to one task, which drops shingles that one member has alone, counts all
common shingles by matrix products, and returns a spanning forest of the links, not the links.

A larger group never meets in one task. Its members are compared with the hub, then with the member most
like the hub, the centre. What is then still apart is compared by differences from the centre: for
members x, y with difference sets Dx, Dy the distance |x ^ y| is |Dx| + |Dy| - 2 |Dx & Dy|, so that a link
between two components needs at least one common difference, and a lower bound for their number follows
from the sizes. Prefixes of the difference sets in the order of rarity, without what one member has
alone, therefore name subgroups that hold every link left. In each the members are compared with the one
nearest the centre, and only what the bounds then still allow between different components is compared
pair by pair. This loses no link, and pairs grow with the members and not with their square unless
members are as near as the threshold allows without being linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import HOT_SHARE, discard, materialize, shuffle_partitions
from .components import connected_components

#: A function (bytes, offsets) -> (hashes, row bounds): each row's distinct shingle hashes, sorted.
Sets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Largest group that one task links by itself: members, and bytes of their texts. The task then holds 80 MB
#: of common counts and links.
GROUP_ROWS, GROUP_BYTES = 4096, 16_000_000
#: Keys of fewer rows are never treated as hot, whatever their share; packed bytes of keys that one task holds.
HOT_ROWS, BUCKET_BYTES = 1_000_000, 8_000_000
#: Shingles whose members are held as a dense matrix at a time, and up to how many members a shingle's pairs
#: are counted one by one instead.
_COLUMNS, _FEW = 1024, 8


def _pack_keys(batches: Iterator[pa.RecordBatch], bits: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per batch of rows (id, bands) and bucket of the key space one block of sorted keys with their ids. Keys are
    cut to ``bits`` bits; a chance agreement only makes a candidate more."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        keys = lists.flatten().to_numpy().view(np.uint64)
        ids = np.repeat(batch.column(0).to_numpy(), sizes)
        if len(hot):
            rest = ~np.isin(keys, hot)
            keys, ids = keys[rest], ids[rest]
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        bucket = K.bucket_of(keys, buckets)
        keys >>= K.U(64 - bits)
        rows = [(int(bucket[x]), K.pack(np.diff(keys[x:y], prepend=K.U(0)), ids[x:y])) for x, y in K.equal_runs(bucket)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])


def _hubs(table: pa.Table) -> pa.Table:
    """(hub, id) of a bucket's blocks: for each key that several ids have, the least id with each other."""
    parts = [K.unpack(p) for p in table["payload"].to_pylist()]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    ids = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(first, len(keys)))
    hub = np.repeat(np.minimum.reduceat(ids, first), count)
    pairs = np.unique(np.column_stack((hub, ids))[hub != ids], axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hub", "id"])


def hub_members(banded: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stored distinct (hub, id) of the stored rows (id, bands): for each key that is in the bands of several ids, the
    least of them, the hub, with each of the others.

    Keys are dealt out once, packed, to buckets of bounded size. Keys with so many rows that one task would be
    slow are looked for in a sample of about a million keys; there are at most some thousands. Their hubs are
    aggregated on the map side and broadcast instead."""
    spark = banded.sparkSession
    total = banded.agg(F.sum(F.size("bands"))).first()[0] or 0
    hot, known = np.zeros(0, np.uint64), None
    if total >= hot_rows:
        part = max(1, total // 1_000_000)
        sampled = banded.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(part)) == 0).select(F.explode("bands").alias("key"))
        often = sampled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") * part >= hot_rows) & (F.col("n") * part * HOT_SHARE >= total))
        found = [r["key"] for r in often.select("key").collect()]
        hot = np.array(found, np.int64).view(np.uint64)
        known = spark.createDataFrame([(k,) for k in found], "key long") if found else None
    buckets = max(1, -(-total * 12 // BUCKET_BYTES), min(shuffle_partitions(spark), -(-total // 50_000)))
    bits = min(64, max(24, int(total).bit_length() + 12))
    blocks = banded.select("id", "bands").mapInArrow(lambda batches: _pack_keys(batches, bits, buckets, hot), "bucket int, payload binary")
    pairs = blocks.groupBy("bucket").applyInArrow(lambda table: _hubs(table), "hub long, id long")
    if known is not None:
        crowd = banded.select("id", F.explode("bands").alias("key")).join(F.broadcast(known), "key")
        hubs = crowd.groupBy("key").agg(F.min("id").alias("hub"))
        pairs = pairs.unionAll(crowd.join(F.broadcast(hubs), "key").filter("hub < id").select("hub", "id"))
    return materialize(pairs.distinct(), "members", 10_000)


def _text_sets(col: pa.Array, sets: Sets) -> list[np.ndarray]:
    buf, offs = K.text_buffer(col)
    out = []
    for i, j, part, at in K.slices(buf, offs, K.SLICE):
        h, bounds = sets(part, at)
        out += [h[bounds[r] : bounds[r + 1]] for r in range(j - i)]
    return out


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(root, member) of the links among a group's sets: each component as a star around its first member."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if common and 100 * common >= percent * (sizes.sum() - common) else []
    owner = np.repeat(np.arange(n), sizes)
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[shingle] > 1
    rank = np.cumsum(times > 1) - 1
    column, owner = rank[shingle[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    members = np.bincount(column)
    common = np.zeros((n, n), np.float32)
    few = members[column] <= _FEW
    head = np.repeat(np.cumsum(members) - members, members)
    for step in range(1, _FEW):  # pairs of a rare shingle's members that are ``step`` apart in its list
        i = np.flatnonzero(few & (np.arange(len(column)) - head + step < members[column]))
        np.add.at(common, (owner[i], owner[i + step]), 1)
        np.add.at(common, (owner[i + step], owner[i]), 1)
    rank = np.cumsum(members > _FEW) - 1
    column, owner = rank[column[~few]], owner[~few]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        x, y = np.searchsorted(column, (a, a + _COLUMNS))
        has = np.zeros((n, _COLUMNS), np.float32)
        has[owner[x:y], column[x:y] - a] = 1
        common += has @ has.T
    linked = np.empty((n, n), bool)
    for a in range(0, n, 512):
        part = common[a : a + 512]
        linked[a : a + 512] = (part > 0) & (100.0 * part >= percent * (sizes[a : a + 512, None] + sizes[None, :] - part.astype(np.float64)))
    np.fill_diagonal(linked, False)
    out, left = [], np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            new = np.flatnonzero(linked[front].any(0) & left)
            left[new] = False
            out += [(root, int(x)) for x in new]
            front = new.tolist()
    return out


def _linked_groups(batches: Iterator[pa.RecordBatch], sets: Sets, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the groups in rows (hub, id, text) that are sorted by hub; a group may span batches."""
    rest: pa.Table | None = None

    def solve(rows: pa.Table) -> pa.RecordBatch:
        hubs, ids = rows["hub"].to_numpy(), rows["id"].to_numpy()
        text_sets = _text_sets(rows["text"], sets)
        a, b = [], []
        for x, y in K.equal_runs(hubs):
            for p, q in forest(text_sets[x:y], percent) if y - x > 1 else ():
                a.append(ids[x + p])
                b.append(ids[x + q])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not rows.num_rows:
            continue
        hubs = rows["hub"].to_numpy()
        done = int(np.searchsorted(hubs, hubs[-1]))
        if done:
            yield solve(rows.slice(0, done))
        rest = rows.slice(done).combine_chunks()
    if rest is not None and rest.num_rows:
        yield solve(rest)
    K.trim()


def _compare(pairs: DataFrame, texts: DataFrame, sets: Sets, apart: bool = False) -> DataFrame:
    """For rows (g, a, b): n_a and n_b, the sizes of both sets, and their common shingles; or (``apart``)
    the shingles that only one of both has."""
    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _text_sets(batch.column(3), sets), _text_sets(batch.column(4), sets)
            common = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)]
            cols = [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in ([len(p) for p in x], [len(q) for q in y], common))]
            names = ["g", "a", "b", "n_a", "n_b", "common"]
            if apart:
                cols.append(pa.array([np.setxor1d(p, q, assume_unique=True).view(np.int64) for p, q in zip(x, y, strict=True)], pa.list_(pa.int64())))
                names.append("apart")
            yield pa.record_batch(cols, names=names)

    both = pairs.join(right, "b").join(left, "a").select("g", "a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "g long, a long, b long, n_a long, n_b long, common long" + ", apart array<long>" * apart)


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter((F.col("common") > 0) & (100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))).select("a", "b")


def _still_apart(rows: DataFrame, comps: DataFrame, key: list[str]) -> DataFrame:
    """The rows, with their component, of the keys whose ids are in several components."""
    marked = rows.join(comps, rows["id"] == comps["node"], "left").drop("node").withColumn("comp", F.coalesce("component", "id")).drop("component")
    several = marked.groupBy(*key).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select(*key)
    return marked.join(several, key)


def _link_large(large: DataFrame, texts: DataFrame, sets: Sets, percent: int, links: DataFrame) -> DataFrame:
    """``links`` and those of the groups (hub, id) that are too large for one task."""
    stored: list[DataFrame] = []

    def store(df: DataFrame, tag: str) -> DataFrame:
        stored.append(materialize(df, tag))
        return stored[-1]

    def more(df: DataFrame) -> DataFrame:
        return store(links.unionAll(df).distinct(), "links")

    def components() -> DataFrame:
        stored.append(connected_components(links))
        return stored[-1]

    # with the hub
    first = store(_compare(large.filter("hub < id").select(F.col("hub").alias("g"), F.col("hub").alias("a"), F.col("id").alias("b")), texts, sets), "hub-pairs")
    links = more(_links(first, percent))
    # with the member most like it
    left = store(_still_apart(large, components(), ["hub"]).select("hub", "id"), "apart")
    like = F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    centre = first.groupBy("g").agg(F.max_by("b", F.struct(like, -F.col("b"))).alias("a"))
    second = left.join(centre, left["hub"] == centre["g"]).filter("id <> a").select("g", "a", F.col("id").alias("b"))
    second = store(_compare(second, texts, sets), "centre-pairs")
    links = more(_links(second, percent))
    # by differences from it: w is (100 + p) |D| - (100 - p) n, and a link needs 2 (100 + p) |Dx & Dy| >= wx + wy
    step, off = 100 + percent, 100 - percent
    left = _still_apart(second.select("g", "a", F.col("b").alias("id")), components(), ["g"])
    apart = store(_compare(left.select("g", "a", F.col("id").alias("b")), texts, sets, apart=True), "differences")
    apart = apart.select("g", F.col("b").alias("id"), (step * F.size("apart") - off * F.col("n_b")).alias("w"), "apart")
    shingles = apart.select("g", "id", F.explode("apart").alias("x"))
    shared = shingles.groupBy("g", "x").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    kept = shingles.join(shared, ["g", "x"]).groupBy("g", "id").agg(F.sort_array(F.collect_list(F.struct("times", "x"))).alias("d"))
    bound = apart.groupBy("g").agg(F.min("w").alias("least"))
    need = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("least")) / (2 * step))).cast("int")
    kept = kept.join(apart.drop("apart"), ["g", "id"]).join(bound, "g").withColumn("need", need).filter("size(d) >= need")
    prefix = F.slice("d", F.lit(1), F.size("d") - F.col("need") + 1)
    rows = kept.select("g", "id", "w", F.size("d").alias("n"), F.posexplode(prefix).alias("at", "e")).select("g", F.col("e.x").alias("x"), "id", "w", (F.col("n") - F.col("at")).alias("rest"))
    rows = store(rows, "prefixes")
    possible = lambda x, y: 2 * step * F.least(x["rest"], y["rest"]) >= x["w"] + y["w"]
    # in each subgroup, with the member nearest the centre
    left = store(_still_apart(rows, components(), ["g", "x"]), "apart")
    near = left.groupBy("g", "x").agg(F.min(F.struct("w", "id", "rest", "comp")).alias("y"))
    pairs = left.join(near, ["g", "x"]).withColumn("z", F.struct("w", "rest")).filter((F.col("comp") != F.col("y.comp")) & possible(F.col("z"), F.col("y")))
    pairs = store(pairs.select(F.lit(0).cast("long").alias("g"), F.least("id", "y.id").alias("a"), F.greatest("id", "y.id").alias("b")).distinct(), "pairs")
    links = more(_links(_compare(pairs, texts, sets), percent))
    # what is then possible between components that are still apart
    left = store(_still_apart(rows, components(), ["g", "x"]), "apart")
    one, two = left.alias("one"), left.alias("two")
    apart_still = (F.col("one.g") == F.col("two.g")) & (F.col("one.x") == F.col("two.x")) & (F.col("one.id") < F.col("two.id")) & (F.col("one.comp") != F.col("two.comp"))
    bounded = 2 * step * F.least("one.rest", "two.rest") >= F.col("one.w") + F.col("two.w")
    last = one.join(two, apart_still & bounded).select(F.lit(0).cast("long").alias("g"), F.col("one.id").alias("a"), F.col("two.id").alias("b")).distinct()
    out = materialize(links.unionAll(_links(_compare(last.join(pairs, ["a", "b"], "left_anti").select("g", "a", "b"), texts, sets), percent)), "links")
    discard(*stored)
    return out


def link(members: DataFrame, texts: DataFrame, sets: Sets, percent: int, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Stored (node, component) of the ids that links connect.

    members: stored (hub, id) as from ``hub_members``; texts: stored (id, text), one row for each id and hub."""
    spark = members.sparkSession
    whole = members.unionAll(members.select("hub", F.col("hub").alias("id")).distinct())
    sizes = whole.join(texts.select("id", F.octet_length("text").cast("long").alias("bytes")), "id").groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    large_hubs = materialize(sizes.filter((F.col("n") > group_rows) | (F.col("bytes") > group_bytes)).select("hub"), "large-hubs")
    n_large = large_hubs.count()
    small = whole.join(large_hubs, "hub", "left_anti") if n_large else whole
    dealt = small.join(texts, "id").select("hub", "id", "text").repartition(shuffle_partitions(spark), "hub").sortWithinPartitions("hub", "id")
    links = materialize(dealt.mapInArrow(lambda batches: _linked_groups(batches, sets, percent), "a long, b long"), "links")
    if n_large:
        large = materialize(whole.join(large_hubs, "hub"), "large-groups")
        before, links = links, _link_large(large, texts, sets, percent, links)
        discard(before, large)
    out = connected_components(links)
    discard(links, large_hubs)
    return out
