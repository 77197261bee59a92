"""Clustering, hard negatives and the quality network: against brute force, on rows with the awkward cases, and on held-out labels."""

import hashlib
import zlib

import numpy as np
import pytest

from visorq.llm import clustering, hard_negatives, quality_cnn, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, n int, cluster int, id string, rank int, __k1 int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2, "i", 3, 4) for i, v, y in rows], SCHEMA)


def vectors(n=400, dim=6, seed=1, coarse=False):
    rng = np.random.default_rng(seed)
    out = [(i, (rng.integers(-3, 4, dim) / 4 if coarse else rng.normal(size=dim)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    third = out[5][1]
    out += [(1000 + i, third, i % 3) for i in range(n // 2)]  # a third of all rows are one vector
    out += [(2000, None, 1), (2001, [1.0] * (dim - 1) + [None], 1), (2002, [float("nan")] + [1.0] * (dim - 1), 1), (2003, [float("inf")] + [0.0] * (dim - 1), 2)]
    return out


def integers(v):
    return tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, integers(v)) for i, v, _ in rows if good(v) and len(v) == dim]
    order = sorted((r for r in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), x in zip(kept, of) if x == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    done = [(i, *near(v)) for i, v in kept]
    own = {j: sum(d for _, d, x in done if x == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for i, d, j in done), key=repr)


def clusters(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("coarse", [False, True])
def test_clusters(spark, coarse):
    rows = vectors(coarse=coarse)
    rows += [(None, rows[3][1], 1), (7, rows[8][1], 1), (7, rows[7][1], 1), (3000, [0.5] * 5, 1), (3001, [], 0), (3002, rows[9][1], None)]
    got = clustering.cluster(frame(spark, rows), k=8, rounds=3, dim=6)
    assert clusters(got) == brute_clusters(rows, 8, 3, 6)


def test_clusters_of_few_and_no_rows(spark):
    few = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [-1.0, 0.5], None)]
    assert clusters(clustering.cluster(frame(spark, few), k=40, dim=2)) == brute_clusters(few, 40, 5, 2)
    empty = clustering.cluster(frame(spark, []), dim=2)
    assert empty.columns[:3] == ["vec_id", "cluster", "distance"] and empty.collect() == []
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(frame(spark, [(1, [1e9, 0.0], 0)]), dim=2).collect()


def test_large_components_and_weights_are_exact():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-(1 << 27), 1 << 27, (5, 64))
    best, d = clustering.assign(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, u)), j) for j, u in enumerate(c)) for v in x]
    assert list(zip(d.tolist(), best.tolist())) == want
    total = np.zeros((5, 65), object)
    clustering.weighted_sums(x, np.full(50, 1 << 45), best, total)
    assert total[:, 1].tolist() == [sum(int(v[0]) << 45 for v, b in zip(x, best) if b == j) for j in range(5)]


def brute_negatives(rows, every=50, positives=5, negatives=3):
    held = {}
    for i, v, y in rows:
        if good(v) and y is not None and i is not None:
            one = ((y + 1) % 10 if i % 7 == 0 else y, integers(v))
            held[i] = min(held.get(i, one), one)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        score = sorted(((-dot(v, w), i, y) for i, (y, w) in held.items() if i != a))
        for s, p, _ in [x for x in score if x[2] == label][:positives]:
            inside = [(i, -n) for n, i, y in score if y != label and -50 * s <= -100 * n <= -95 * s]
            out += [(a, p, r + 1, i, -s, n) for r, (i, n) in enumerate(inside[:negatives])]
    return sorted(out)


def negatives(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("coarse", [False, True])
def test_hard_negatives(spark, coarse):
    rows = vectors(dim=8, coarse=coarse)
    rows += [(None, rows[3][1], 1), (50, rows[8][1], 0), (50, rows[7][1], 0), (52, rows[52][1], rows[52][2]), (3000, [0.5] * 5, 1), (3001, [], 0), (3050, [], 1), (3003, rows[9][1], None)]
    got = hard_negatives.hard_negatives(frame(spark, rows), every=10, parts=4, sample=100, row_block=90, anchor_block=17)
    want = brute_negatives(rows, every=10)
    assert negatives(got) == want and len(want) > 100


def test_hard_negatives_of_no_rows_and_other_columns_names(spark):
    assert hard_negatives.hard_negatives(frame(spark, [])).collect() == []
    assert hard_negatives.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [2.0], 1)])).collect() == []
    zeros = [(i, [0.0, 0.0], i % 3) for i in range(0, 300, 5)]  # all scores tie at nought
    assert negatives(hard_negatives.hard_negatives(frame(spark, zeros))) == brute_negatives(zeros)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    x = rng.integers(-150, 150, (3000, 64))
    books = hard_negatives.Codebooks(x[:1000], 32)
    codes, left = books.encode(x)
    anchor, calls = x[7], [0]
    score = books.tables(anchor)[np.arange(32), codes].sum(1)
    slack = left @ hard_negatives.lengths(books.cut(anchor[None, :]))[0]
    true = x @ anchor
    assert (true >= score - slack).all() and (true <= score + slack).all()

    def exact(r):
        calls[0] += len(r)
        return true[r]

    top = int(np.sort(true)[-20])
    at, got = hard_negatives.first_of(np.arange(3000), score - slack, score + slack, exact, 3, top // 2, top)
    inside = sorted((-s, i) for i, s in enumerate(true.tolist()) if top // 2 <= s <= top)[:3]
    assert list(zip((-got).tolist(), at.tolist())) == inside
    assert calls[0] < 1500  # most rows never meet an exact product


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op11_quality_cnn(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.93
    assert np.mean([s >= 0.7 for s in ones]) > 0.9 and np.mean([s < 0.7 for s in zeros]) > 0.5


def small_network():
    rng = np.random.default_rng(2)
    junk = [b"".join(rng.choice([b"### ", b"$$$ ", b"abc "]) for _ in range(rng.integers(1, 300))) for _ in range(60)]
    prose = [b"".join(rng.choice([b"word ", b"other ", b"abc "]) for _ in range(rng.integers(1, 300))) for _ in range(60)]
    return quality_cnn.fit([*junk, *prose], np.array([0] * 60 + [1] * 60, np.float32), epochs=4), junk, prose


def test_network_covers_whole_texts(spark, monkeypatch):
    net, junk, prose = small_network()

    def alone(t):
        """Features by their definition: every window of every chunk."""
        codes = np.concatenate([np.frombuffer(t, np.uint8).astype(np.int64), np.full(quality_cnn.WIDTH, 256)])
        if not t:
            return np.zeros(2 * quality_cnn.FILTERS)
        out = np.stack([net.embed[codes[i : i + quality_cnn.WIDTH]].reshape(-1) @ net.filters for i in range(len(t))])
        tops = np.stack([np.maximum(out[i : i + quality_cnn.CHUNK].max(0) + net.bias, 0) for i in range(0, len(t), quality_cnn.CHUNK)])
        return np.concatenate([tops.mean(0), tops.max(0)])

    texts = [b"", b"a", junk[0], prose[0] * 9, "日本 ".encode() * 700, b"x" * 511, b"x" * 512, b"x" * 513, prose[1] * 20 + junk[1]]
    want = quality_cnn.sigmoid(np.stack([alone(t) for t in texts]) @ net.weight + net.offset)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    assert np.allclose(net.score(buf, offs), want, atol=1e-4)
    monkeypatch.setattr(quality_cnn, "_SLICE", 1500)  # the long texts in runs of chunks
    assert np.allclose(net.score(buf, offs), want, atol=1e-4)
    monkeypatch.undo()
    rows = [(1, None), (2, ""), (None, "abc ### "), (3, (prose[2] * 400).decode()), (3, "word")]
    df = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "doc_id long, text string, quality string, score double")
    got = quality_cnn.score_quality(df, net).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "None"] and len({round(r.score, 6) for r in got if r.doc_id in (1, 2)}) == 1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    net = quality_cnn.Network.new(rng, 0.6)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (0, 3, 700, 1300)]
    offs, buf, y = np.concatenate(([0], np.cumsum([len(t) for t in texts]))), np.frombuffer(b"".join(texts), np.uint8), np.array([1, 0, 1, 0], np.float32)

    def loss():
        p = net.score(buf, offs)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in zip(("filters", "weight", "bias", "embed"), [net.gradients(buf, offs, y)[k] for k in (1, 3, 2, 0)], strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        held, e = getattr(net, name), 1e-2
        diff = []
        for sign in (1, -1):
            other = held.copy()
            other[at] += sign * e
            setattr(net, name, other)
            diff.append(loss())
        setattr(net, name, held)
        assert abs((diff[0] - diff[1]) / (2 * e) - g[at]) < 0.05 * abs(g[at]) + 1e-3, name


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality_cnn.quality(docs, labels).collect()} == {(0.5, 0)}
    one_kind = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert len({r.score for r in quality_cnn.quality(docs, one_kind).collect()}) == 1
    assert quality_cnn.quality(docs.limit(0), labels).collect() == []
