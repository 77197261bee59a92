"""Each operator against brute force on texts with the awkward cases: null, empty, blank, one word, very long,
repeated rows, ties, non-ASCII, extra columns with clashing names, and empty tables."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute as B  # noqa: E402

from visorq.llm import (  # noqa: E402
    bpe,
    components,
    decontaminate,
    line_dedup, lsh,
    near_dup,
    pii,
    quality_rules,
    queries,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    warc,
)

SCHEMA = "doc_id long, text string, source string, id string, bands int, chunk int, row string, lines string, gone string, key long"
EMPTY = (None, "", "  \n\t ", "one")


def make(seed=3):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "délta", "εψιλον", "zeta7", "eta", "theta,", "日本", "iota's", "kappa.", "x"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\n"]) for _ in range(n))
    passage, base = " ".join(rng.choice(vocab) + str(i) for i in range(70)), text(120)
    out = [(i, t) for i, t in enumerate(EMPTY)]
    out += [(10 + i, text(rng.randint(1, 60))) for i in range(25)]
    out += [(40, base), (41, base), (42, base + " tail"), (43, base.replace("gamma", "GAMMA")), (44, text(20) + passage + text(20)), (45, passage + "\n" + text(9)), (46, text(4) + passage)]
    out += [(50, " ".join(f"w{i % 997}" for i in range(6000))), (51, "y" * 5000), (52, "ab " * 300)]
    long = " ".join(f"v{i * i % 3989}" for i in range(45_000))  # longer than a slice, on one line
    out += [(53, long), (54, long + " and some more words behind it")]
    out += [(60, "the same line of some length here\nother " + text(5)), (61, "the same line of some length here\nthe same line of some length hera\nshort\nshort")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, f"s{(d or 0) % 3}" if d != 11 else None, "x", 1, 2, "r", "l", "g", 5) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return make()


def test_suffix_dedup(spark, rows):
    rows = rows + [(41, rows[30][1]), (None, rows[33][1])]  # a repeated id and a null id
    got = suffix_dedup.removed_bytes(frame(spark, rows), chunk_bytes=3000, bucket_bytes=9000).collect()
    mine = sorted(((r.doc_id, r.n_bytes, r.n_removed, len([x for x in r.spans.split(",") if x]), B.sha(bytes(r.kept))) for r in got), key=repr)
    assert mine == sorted(B.suffix(rows), key=repr)


def test_loser_tree_against_sort():
    rng = np.random.default_rng(5)
    for runs_n in (1, 2, 3, 7, 16):
        raw = [rng.integers(0, 3, (rng.integers(1, 60), 21), dtype=np.uint8) for _ in range(runs_n)]
        raw = [np.unique(r, axis=0) for r in raw]
        runs = [suffix_dedup._words(r) for r in raw]
        prefix = [np.array([0, *(int((x != y).argmax()) for x, y in zip(r[1:], r))]) for r in raw]
        run, place, common = suffix_dedup.loser_tree_merge(runs, [suffix_dedup.codes_of(w, p) for w, p in zip(runs, prefix)])
        out = [tuple(runs[a][b]) for a, b in zip(run, place)]
        assert out == sorted(out)
        assert [next((k for k in range(3) if x[k] != y[k]), 3) for x, y in zip(out, out[1:])] == common[1:].tolist()


def test_front_coding_round_trip():
    rng = np.random.default_rng(6)
    right, width = suffix_dedup._layout(50)
    rows = np.zeros((200, width), np.uint8)
    for r in rows:
        a, b = rng.integers(14, 51), rng.integers(0, 37)
        r[:a], r[right], r[right + 1 : right + 1 + b], r[right + 37] = rng.integers(97, 99, a), a, rng.integers(97, 99, b), b
    rows = rows[np.lexsort(rows.T[::-1])]
    assert (suffix_dedup.front_decode(*suffix_dedup.front_code(rows, 50), 50) == rows).all()


def test_substring_dedup(spark, rows):
    rows = rows + [(41, rows[30][1]), (None, rows[33][1])]
    got = substring_dedup.removed_words(frame(spark, rows), chunk_bytes=3000, bucket_bytes=9000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, B.sha(r.kept.encode())) for r in got), key=repr) == sorted(B.substrings(rows), key=repr)


def test_near_duplicates(spark, rows):
    for percent in (80, 85):
        got = {tuple(r) for r in near_dup.near_duplicates(frame(spark, rows), percent=percent).collect()}
        assert got == B.near(rows, percent)


def test_near_duplicates_with_null_and_repeated_ids(spark, rows):
    got = near_dup.near_duplicates(frame(spark, [*rows, (40, rows[29][1]), (None, rows[29][1])])).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert [r.component_id for r in got if r.doc_id in (40, 41)] == [40, 40, 40]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    for most in (10**6, 0):
        got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=most).collect()))
        assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_chain_of_near_copies_in_shared_buckets(spark):
    # each text is close to the next one only, so no hub sees them all
    w = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(w[12 * i : 12 * i + 200])) for i in range(12)]
    got = {tuple(r) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == B.near(rows, 80)


def near_copies(n=150, words=120, seed=4):
    """Copies of one text with a few words changed each: all in each other's buckets, many just not linked."""
    rng, out = random.Random(seed), []
    for i in range(n):
        w = [f"w{k}" for k in range(words)]
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 5])):
            w[rng.randrange(words)] = f"n{rng.randrange(4000)}" if rng.random() < 0.8 else "same"
        out.append((i + 1, " ".join(w)))
    return out


@pytest.mark.parametrize("group_rows", [lsh.GROUP_ROWS, 4])
def test_group_of_near_copies(spark, group_rows):
    """In one task, and as a group that is too large for one."""
    rows = [*near_copies(), (900, near_copies()[3][1])]
    for percent in (80, 90):
        got = {tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, group_rows=group_rows).collect()}
        assert got == B.near(rows, percent)


def test_pairs_grow_with_members_not_their_square(spark, monkeypatch):
    made = []
    real = lsh._compare

    def counted(pairs, *args, **kw):
        made[-1] += pairs.count()
        return real(pairs, *args, **kw)

    monkeypatch.setattr(lsh, "_compare", counted)
    for n in (150, 600):
        made.append(0)
        rows = near_copies(n)
        members = spark.createDataFrame([(1, d) for d, _ in rows[1:]], "hub long, id long")
        texts = spark.createDataFrame(rows, "id long, text string")
        got = {r.node: r.component for r in lsh.link(members, texts, lambda b, o: near_dup.shingle_sets(b, o, 5), 80, group_rows=10).collect()}
        want = {d: c for d, _, c, _ in B.near(rows, 80)}
        assert got == {d: c for d, c in want.items() if c in [x for d2, x in want.items() if d2 != c]}
    assert made[1] < 8 * made[0]


def test_hot_keys_have_the_same_hubs(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2, 3, 4 + i]), i) for i in range(400)] + [(1, 5), (2, 5)]
    keys = lambda k: (k * 0x9E3779B97F4A7C15) % 2**64 - 2**63
    members = spark.createDataFrame([(i, [keys(k)]) for k, i in rows], "id long, bands array<long>")
    least = {k: min(i for j, i in rows if j == k) for k, _ in rows}
    want = {(least[k], i) for k, i in rows if i > least[k]}
    for hot in (10**9, 50):
        assert {tuple(r) for r in lsh.hub_members(members, hot_rows=hot).collect()} == want


def removals(df, **how):
    keys = {(r[1], r[2]): r[0] for r in line_dedup._keyed(df, "doc_id", "text").select("d", "__r1", "__r2").collect()}
    return {(keys[r[0], r[1]], r[2]) for r in line_dedup.duplicate_lines(df, **how).collect()}


def test_line_dedup(spark, rows):
    want = B.lines(rows)
    assert (61, 3) in want  # a line of five characters
    got = removals(frame(spark, rows))
    assert got == want
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "line_dedup"]
    texts = {r.doc_id: r.text for r in out.collect()}
    for d, t in rows:
        assert texts[d] == (t if not any(g[0] == d for g in got) else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got))


def test_groups_of_near_lines(spark):
    rng = random.Random(9)
    rows = []
    for i in range(90):
        out = []
        for _ in range(rng.randrange(6)):
            t = list("the quick brown fox jumps over the lazy dog and then goes home")
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice("abcdefgxyz日é")
            out += ["".join(t), rng.choice(["short", "kürz x", "a b c d e f g h", "", "  ", "a b c d e f g i"])]
        rows.append((i + 1, "\n".join(out)))
    for group_rows in (lsh.GROUP_ROWS, 4):
        assert removals(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=group_rows) == B.lines(rows)


def test_lines_of_null_and_shared_ids(spark):
    rows = [
        (None, "a line that many rows have\nIRREPLACEABLE second line of one null row"), (None, "a line that many rows have\nsomething else entirely"),
        (7, "q w e r t y u i o p\nunique one of seven"), (7, "unrelated stuff\nq w e r t y u i o p"), (8, "q w e r t y u i o p"), (8, "q w e r t y u i o p"), (9, None), (None, None),
    ]
    df = spark.createDataFrame([(d, t, "kept", 1) for d, t in rows], "doc_id long, text string, line_dedup string, line_dedup_ int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "line_dedup", "line_dedup_", "line_dedup__"]
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(rows) and all(r.line_dedup == "kept" for r in out.collect())
    lines = sorted(x for _, t in got if t for x in t.split("\n") if x)
    # the two equal rows of id 8 are one document, and its line is that of the rows of id 7
    assert lines == sorted(["a line that many rows have", "IRREPLACEABLE second line of one null row", "something else entirely", "q w e r t y u i o p", "unique one of seven", "unrelated stuff"])


def test_lines_that_share_their_first_hash(spark, monkeypatch):
    """Different lines under one 64-bit name are linked as any others."""
    real = line_dedup.line_signatures
    clash = lambda *a: real(*a).withColumn("h1", F.when(F.col("line") == 0, F.lit(7)).otherwise(F.col("h1")))
    monkeypatch.setattr(line_dedup, "line_signatures", clash)
    rows = [(1, "aaa bbb ccc ddd eee fff ggg\nzz"), (2, "hhh iii jjj kkk lll mmm nnn\nzz"), (3, "aaa bbb ccc ddd eee fff ggg\nyy"), (4, "aaa bbb ccc ddd eee fff ggh\nyy z")]
    assert removals(spark.createDataFrame(rows, "doc_id long, text string")) == {(2, 1), (3, 0), (4, 0)}


def test_sets_that_share_their_short_name(spark, monkeypatch):
    real = near_dup.signatures
    monkeypatch.setattr(near_dup, "signatures", lambda *a: real(*a).withColumn("set_id", F.lit(7).cast("long")))
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base), (3, base + " tail"), (4, "something else that has more than five words")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_components_in_one_task_and_in_steps(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = [sorted(map(tuple, components.connected_components(frame, one_task=n).collect())) for n in (10**6, 0)]
    assert got[0] == got[1] and len(got[0]) > 100


def test_recall_of_line_bands():
    """Pairs of lines at a similarity of 0.8 or just above: the share that meets in a bucket."""
    rng, met, pairs = np.random.default_rng(3), 0, 3000
    for _ in range(pairs):
        common, own = 80, 10
        x = rng.integers(0, 2**32, common + 2 * own, dtype=np.uint64).astype(np.uint32)
        both = np.concatenate((x[: common + own], x[:common], x[common + own :]))
        keys = near_dup.band_keys(line_dedup._minima(both, np.array([0, common + own]), 80), 5)
        met += (keys[:, 0] == keys[:, 1]).any()
    assert met >= 0.99 * pairs


def test_recall_of_document_bands():
    """Pairs of sets at a similarity of 0.85: all but one in millions meet in a bucket."""
    rng, met, pairs = np.random.default_rng(6), 0, 3000
    for _ in range(pairs):
        common, own = 170, 15
        x = rng.integers(0, 2**64, common + 2 * own, dtype=np.uint64)
        both = np.concatenate((x[: common + own], x[:common], x[common + own :]))
        keys = near_dup.band_keys(near_dup.circulant_signature(both, np.array([0, common + own, 2 * (common + own)]), 192), 6)
        met += (keys[:, 0] == keys[:, 1]).any()
    assert met >= 0.999 * pairs


def test_decontamination(spark, rows):
    items = [(1, rows[33][1][:150]), (2, "one"), (3, None), (4, ""), (5, rows[35][1][40:200]), (None, "w3 w4 w5 w6"), (6, "zeta7 eta")]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    want = sorted(B.contaminated(rows, items), key=repr)
    for how in ({}, {"block_windows": 3, "shard_bytes": 2000}):
        got = decontaminate.decontaminate(frame(spark, rows), bench, **how).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == want
        assert all(set(r["items"]) <= set(r.near_items) for r in got)


def test_candidates_taken_in_parts_are_the_same(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    terms = rng.integers(0, 6, 400)
    order = np.argsort(terms, kind="stable")
    known, first = np.unique(terms[order], return_index=True)
    places = [np.diff(np.sort(x), prepend=0).astype("<u4").tobytes() for x in np.split(order, first[1:])]
    lists = decontaminate.Lists(known.astype(np.int64), pa.array(places, pa.binary()))
    at = rng.integers(0, 390, 30)
    ranks = np.array([[terms[a + 1], terms[a], terms[a + 2]] for a in at])
    offsets, sizes = np.tile(np.array([1, 0, 2]), (30, 1)), np.full(30, 3)
    whole = decontaminate.intersect(lists, ranks, offsets, sizes, 1)
    monkeypatch.setattr(decontaminate, "_CANDIDATES", 50)
    parts = decontaminate.intersect_all(lists, ranks, offsets, sizes, 1)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    exact = {(int(w), int(s)) for w, s, e in zip(*whole) if e}
    assert exact == {(w, s) for w, a in enumerate(at) for s in range(398) if (terms[s : s + 3] == terms[a : a + 3]).all()}


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "a b c x d e f g h i j"), (2, "j i h g f e d c b a")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a b c d e f g h i j")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got[1]["items"] == [] and got[1].near_items == ["9"] and got[2].near_items == []


def test_bpe(spark, rows):
    from tokenizers import Tokenizer

    rows = [*rows, (70, "a<|endoftext|>b  don't WE'RE 12,345　 x \U0001f600 \r\n\t é ü" * 9), (71, rows[29][1])]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[d] = (np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False))
    for size in (16, 512):
        got = bpe.bpe(frame(spark, rows), queries.tokenizer_path(), chunk_bytes=size).collect()
        assert {r.doc_id: (bytes(r.ids), r.decoded) for r in got} == want


def _small_bpe(path, pre, decoder):
    """A BPE file over letters and a few others, of merges by chance; characters outside have no token."""
    import json

    rng = random.Random(5)
    vocab = {c: i for i, c in enumerate([*map(chr, range(32, 127)), "\n", "é", "日"])}
    merges, pool = [], list("abcdethnr ")
    while len(merges) < 400:
        a, b = rng.choice(pool), rng.choice(pool)
        if a + b not in vocab and len(a + b) <= 6:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
            pool.append(a + b)
    added = [{"id": len(vocab), "content": "<sep>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": decoder, "model": model}))
    return str(path)


def _agrees(path, texts, size):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, cache = Tokenizer.from_file(path), bpe.ChunkCache(path, 10_000_000)
    for row, ids, decoded in bpe.encode_texts(pa.array(texts), cache, size):
        want = tok.encode(texts[row] or "", add_special_tokens=False).ids
        assert (np.frombuffer(ids, "<u4").tolist(), decoded) == (want, tok.decode(want, skip_special_tokens=False)), texts[row]


@pytest.mark.parametrize("pre", [None, {"type": "Whitespace"}])
def test_bpe_of_other_files(tmp_path, pre):
    path, rng = _small_bpe(tmp_path / "t.json", pre, None), random.Random(6)
    texts = ["".join(rng.choice("abcdethnr ") for _ in range(rng.randrange(400))) for _ in range(200)]
    for size in (16, 64, 512):
        _agrees(path, [*texts, "a<sep>b" * 30, "ünknown " * 20, "日 é " * 30, None, ""], size)


def test_bpe_joins_of_awkward_texts():
    rng = random.Random(7)
    pieces = ["don't", "WE'RE", " 's", "'", "''", " ", "  ", "\n", "\n\n", "\t", "\r\n", "123", "４５", "é", "日本", "\U0001f600", "!!", "...", "- ", "x", "the ", " the", "ing", "　", " \n ", "'ll", "ll", "s", "<|end", "oftext|>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(150))) for _ in range(500)]
    for size in (4, 16, 64):
        _agrees(queries.tokenizer_path(), texts, size)


def _every_cut(cache, text):
    """The text's ids from two chunks, cut at each character, by the way joins are repaired."""
    raw = text.encode()
    sure = np.flatnonzero(bpe.sure_cuts(np.frombuffer(raw, np.uint8)))
    for p in range(1, len(raw)):
        if raw[p] & 0xC0 != 0x80:
            parts = cache.encode([raw[:p], raw[p:]])
            yield p, cache.assemble(raw, [0, p, len(raw)], [parts[raw[:p]], parts[raw[p:]]], sure).tolist()


def test_bpe_joins_in_contractions_and_spaces():
    cache = bpe.ChunkCache(queries.tokenizer_path(), 10_000_000)
    words = sorted({t.decode() for t in cache.table if t.isalpha() and t.isascii()})
    assert len(words) > 5000
    for k, c in enumerate(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")):
        for w in words[k % 7 :: 7] + [w for w in words if w[0] in "sltrvemd"][k::7]:
            text = f"they{c}{w} x"
            want = cache.tok.encode(text, add_special_tokens=False).ids
            for p in range(4, 5 + len(c)):  # each place in and beside the contraction
                raw = text.encode()
                parts = cache.encode([raw[:p], raw[p:]])
                assert cache.assemble(raw, [0, p, len(raw)], [parts[raw[:p]], parts[raw[p:]]], np.flatnonzero(bpe.sure_cuts(np.frombuffer(raw, np.uint8)))).tolist() == want, (text, p)
    spaces = [" ", "  ", "\n", " \n", "\n ", "\t\t ", "\r\n\r\n", "\u00a0 ", " \u3000", "\u2028\n", "   \n   "]
    for a in ("word", "3", "!", "'", "é", "日", "\U0001f600", "ß'", "e\u0301", "\u0085"):
        for b in ("word", "7", "?", "'ll", "É", "本", "\u0301", "_x"):
            for s in spaces:
                text = f"x{a}{s}{b} {a}{b}{s}"
                want = cache.tok.encode(text, add_special_tokens=False).ids
                assert all(ids == want for _, ids in _every_cut(cache, text)), text


def test_sure_cuts_are_cuts_of_the_library():
    tok, rng = bpe._tokenizer(queries.tokenizer_path())[0], random.Random(8)
    alphabet = [*map(chr, range(32, 127)), "\n", "\t", "é", "日", "\u3000", "\u00a0", "\u2028", "\U0001f600", "４", "'s", "'ll", "'re", " ", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 30)))
        starts = {len(text[:a].encode()) for _, (a, _) in tok.pre_tokenizer.pre_tokenize_str(text)}
        assert set(np.flatnonzero(bpe.sure_cuts(np.frombuffer(text.encode(), np.uint8))).tolist()) <= starts, text


def test_bpe_of_contractions_at_chunk_joins():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) + "they'learn they'll more't today" * 3 for _ in range(2000)]
    for size in (4, 64, 512):
        _agrees(queries.tokenizer_path(), texts, size)


def test_bpe_of_null_and_repeated_ids(spark, rows):
    df = spark.createDataFrame([(None, "one text"), (None, "one text"), (4, None), (4, "another")], "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.decoded) for r in bpe.bpe(df, queries.tokenizer_path()).collect())
    assert got == [("4", ""), ("4", "another"), ("None", "one text"), ("None", "one text")]


def test_bpe_cache_stays_bounded(rows):
    cache = bpe.ChunkCache(queries.tokenizer_path(), 5000)
    chunks = [c.encode() for _, t in rows if t for c in t.split()]
    for i in range(0, len(chunks), 50):
        cache.encode(chunks[i : i + 50])
        assert cache.size < 60_000


def test_secret_scan(spark, rows):
    key = "0123456789abcdef" * 2
    rows = [*rows, (80, f'é password = "{key}" Api_Key:abcdefgh token=short token=secret: abcdefgh AKIA{"A1" * 8} {key}f'), (81, "SECRET=" + "z" * 9), (None, "passwd: 12345678")]
    got = secret_scan.secret_scan(frame(spark, rows)).collect()
    mine = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.found if s.kind in secret_scan.BASE_KINDS]) for r in got), key=repr)
    assert mine == sorted(((d, B.secrets(t)) for d, t in rows), key=repr)


def test_postings_by_scans_and_by_listing(spark, rows):
    rows = [*rows, (90, "xAbc\nd\U0001f600ef"), (91, "ab")]
    grams = ["abc", "\nd\U0001f600", "c\nd", "eta", "the", " th", "zzz", "日本 "]
    both = [{(r.doc_id, r.gram) for r in secret_scan.trigram_postings(frame(spark, rows), grams, scans=n).collect()} for n in (64, 0)]
    assert both[0] == both[1] == {(d, g) for d, t in rows for g in grams if g in (t or "").lower()}


def test_trigram_queries():
    assert secret_scan.trigram_clauses("abc(def|xyz)?") == [frozenset({"abc"})]
    assert secret_scan.trigram_clauses("[0-9a-f]{32,}") is None
    assert secret_scan.trigram_clauses("Abcd") == [frozenset({"abc", "bcd"})]


def test_pii_keeps_format_and_links(spark):
    values = ["4111111111111111", "2024-02-29", "44.161.181.40", "a.b-1@Mail.org", "DE89370400440532013000", "123-45-6789", "+1 (415) 555-2671"]
    rows = [(1, "x " + " ; ".join(values)), (2, "card 4111111111111111 again"), (3, "4111111111111112 and 999.1.1.1 and 2024-02-30"), (4, None), (5, "")]
    got = {r.doc_id: r for r in pii.pii(frame(spark, rows), b"k").collect()}
    assert len(got[1].spans.split(",")) == 7 and not any(v in got[1].text for v in values)
    new = got[1].text[2:].split(" ; ")
    assert new[0] in got[2].text and len(new[0]) == 16 and not pii._luhn(new[0]) and not pii._mod97(new[4][4:] + new[4][:4]) - 1
    assert [len(a) for a, b in zip(new, values) if b != "44.161.181.40"] == [len(b) for b in values if b != "44.161.181.40"]
    assert got[3].text == rows[2][1] and got[4].text is None and got[5].text == ""


def test_values_against_a_plain_feistel():
    """The permutation written out anew: a square of half-indices, eight rounds, walking until inside the domain."""
    import hashlib
    import math

    key = hashlib.sha256(b"k").digest()

    def plain(value, size, tag):
        side = math.ceil(math.sqrt(size))
        while True:
            a, b = value // side, value % side
            for r in range(8):
                digest = hashlib.blake2b(f"{tag}/{size}/{r}/{b}".encode(), key=key, digest_size=16).digest()
                a, b = b, (a + int.from_bytes(digest, "big")) % side
            value = a * side + b
            if value < size:
                return value

    rng = random.Random(2)
    for _ in range(200):
        octets = [rng.randrange(256) for _ in range(4)]
        n = sum(o << s for o, s in zip(octets, (24, 16, 8, 0)))
        new = plain(n, 2**32, "ip")
        assert pii.pseudonym("ip", ".".join(map(str, octets)), key) == ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
        body = str(rng.randrange(10**14, 10**15))
        card = body + next(str(d) for d in range(10) if not pii._luhn(body + str(d)))
        made = str(plain(int(body), 10**15, "card15")).zfill(15)
        got = pii.pseudonym("card", card, key)
        assert got[:15] == made and not pii._luhn(got) and pii.pseudonym("card", got, key, back=True) == card
        phone = f"+{rng.randrange(1, 10)}{rng.randrange(10**9, 10**10)}"
        made = str(plain(int(phone[2:]), 10 ** len(phone[2:]), f"phone{len(phone) - 2}")).zfill(len(phone) - 2)
        assert pii.pseudonym("phone", phone, key) == phone[:2] + made
        a, g, s = rng.choice([x for x in range(1, 900) if x != 666]), rng.randrange(1, 100), rng.randrange(1, 10_000)
        areas = [x for x in range(1, 900) if x != 666]
        new = plain((areas.index(a) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn")
        assert pii.pseudonym("ssn", f"{a:03}-{g:02}-{s:04}", key) == f"{areas[new // 9999 // 99]:03}-{new // 9999 % 99 + 1:02}-{new % 9999 + 1:04}"
    from datetime import date, timedelta

    days = [(date(1900, 1, 1) + timedelta(i)).isoformat() for i in range(0, 73049, 7)]
    image = {d: pii.pseudonym("date", d, key) for d in days}
    assert len(set(image.values())) == len(days) and all(1900 <= int(x[:4]) < 2100 for x in image.values())
    assert all(pii.pseudonym("date", image[d], key, back=True) == d for d in days)
    assert pii.pseudonym("date", "1899-12-31", key) is None and pii.pseudonym("email", "._@x.org", key) == "._@x.org"


def test_pii_restores_long_texts_and_keeps_rows(spark):
    values = ["4111 1111 1111 1111", "2024-02-29", "44.161.181.40", "anna.b7@mail.org", "DE89 3704 0044 0532 0130 00", "123-45-6789", "13/02/2019"]
    long = " and ".join(f"{v} word{i}" for i in range(3000) for v in values)
    rows = [(1, long), (1, long), (None, values[0]), (2, None)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_card string")
    hidden = pii.pii(df, b"k")
    texts = sorted((r.doc_id or 0, r.text or "") for r in hidden.collect())
    assert len(texts) == 4 and texts[1] == texts[2] and not any(v in texts[1][1] for v in values)
    back = pii.pii(hidden.select("doc_id", "text"), b"k", restore=True).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in back) == sorted((d or 0, t or "") for d, t in rows)


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 97, 1000):
        image = [pii.feistel(i, size, b"k" * 32, "t") for i in range(size)]
        assert sorted(image) == list(range(size))
        assert [pii.feistel(x, size, b"k" * 32, "t", back=True) for x in image] == list(range(size))


def test_quality_verdicts_by_host(spark, rows):
    """kept and host_rate against a plain computation, with a null host, a null text and a null id."""
    docs = [(d, t, f"s{(d or 0) % 3}" if d != 11 else None) for d, t in [*rows, (None, "again " * 30), (11, None)]]
    want = sorted((repr(d), round(rate, 6), kept) for (d, _, _), (rate, kept) in zip(docs, B.host_verdicts(docs)))
    got = quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert sorted((repr(r.doc_id), r.host_rate, r.kept) for r in got) == want


def test_quality(spark, rows):
    rows = [*rows, (11, "again " * 30)]
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    mine = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert mine == sorted((d, *B.quality(t)) for d, t in rows)
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_rejects_a_bad_host_only(spark):
    good = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, good if i % 10 == 0 or i >= 300 else "bad", "spam" if i < 300 else "fine") for i in range(900)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.kept for r in got if r.host == "spam"} == {False} and {r.kept for r in got if r.host == "fine"} == {True}


def test_warc_of_null_ids_and_long_pages(spark, tmp_path):
    pages = [(None, "a", "same"), (3, "b", "same"), (None, None, "only"), (5, "c", "z" * 3_000_000), (6, "d", "z" * 3_000_000), (7, "e", ""), (8, "f", None), (9, "g", "same")]
    df = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, n long, first_id long").repartition(3)
    index = warc.write_warc(df, f"file://{tmp_path}/w")
    got = sorted((repr(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(index, with_payload=False).collect())
    assert got == sorted([("None", 4, "revisit", 3), ("3", 4, "response", None), ("None", 4, "response", None), ("5", 3_000_000, "response", None), ("6", 3_000_000, "revisit", 5),
                          ("7", 0, "response", None), ("8", 0, "revisit", 7), ("9", 4, "revisit", 3)])


def test_records_are_read_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    pages = spark.createDataFrame([(i, "u", rng.bytes(150_000).hex()) for i in range(120)], "page_id long, url string, html string").repartition(2)
    index = warc.write_warc(pages, f"file://{tmp_path}/w")
    read = warc.read_warc(index)
    assert read.rdd.getNumPartitions() >= 4 and read.count() == 120


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/ c", "x" * 100_000), (3, None, "<p>é</p>"), (4, "http://d/", None), (5, "u", ""), (6, "v", "<p>é</p>"), (6, "v", "q")]
    df = spark.createDataFrame([(a, b, c, "d") for a, b, c in pages], "page_id long, url string, html string, sha string").repartition(3)
    index = warc.write_warc(df, f"file://{tmp_path}/w")
    got = {(r.page_id, r.payload_digest): r for r in warc.read_warc(index, gap=10).collect()}
    assert len(got) == 7
    for a, _, c in pages:
        body = (c or "").encode()
        r = got[a, B.base32_sha1(body)]
        first = min(p for p, _, h in pages if (h or "") == (c or ""))
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(body), "response" if a == first else "revisit", None if a == first else first)
        assert r.payload is None if a != first else bytes(r.payload) == body
    assert warc.read_warc(index.filter("page_id = 2")).count() == 1


@pytest.mark.parametrize("name", ["suffix", "substring", "near", "line", "bench", "bpe", "secret", "pii", "quality", "warc"])
def test_empty_tables(spark, name):
    none = frame(spark, []) if name != "warc" else spark.createDataFrame([], "page_id long, url string, html string")
    done = {
        "suffix": lambda: suffix_dedup.removed_bytes(none), "substring": lambda: substring_dedup.removed_words(none), "near": lambda: near_dup.near_duplicates(none),
        "line": lambda: line_dedup.dedup_lines(none), "bench": lambda: decontaminate.decontaminate(none, none.select(F.col("doc_id").alias("item_id"), "text")),
        "bpe": lambda: bpe.bpe(none, queries.tokenizer_path()), "secret": lambda: secret_scan.secret_scan(none), "pii": lambda: pii.pii(none, b"k"),
        "quality": lambda: quality_rules.quality_rules(none), "warc": lambda: warc.read_warc(warc.write_warc(none)),
    }[name]()
    assert done.count() == 0


def test_stored_steps_are_deleted(spark, rows):
    import os

    from visorq.llm import _shared

    docs = frame(spark, rows)
    bench = spark.createDataFrame([(1, rows[33][1][:150])], "item_id long, text string")
    _shared.clear()
    root = _shared.shared_dir(spark).removeprefix("file://")
    there = lambda: set(os.listdir(f"{root}/visorq")) if os.path.isdir(f"{root}/visorq") else set()
    before = there()  # another process may use the folder
    left = lambda: sorted(there() - before)
    for run in (lambda: near_dup.near_duplicates(docs), lambda: line_dedup.dedup_lines(docs), lambda: suffix_dedup.removed_bytes(docs), lambda: substring_dedup.removed_words(docs),
                lambda: decontaminate.decontaminate(docs, bench), lambda: secret_scan.secret_scan(docs), lambda: quality_rules.quality_rules(docs),
                lambda: warc.read_warc(warc.write_warc(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))))):
        run().count()
        assert len(left()) <= 2, left()  # what the returned frame reads
        _shared.clear()
        assert left() == []


def test_settings_come_back(spark, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    near_dup.near_duplicates(frame(spark, rows[:9])).count()
    assert spark.conf.get(name) == before


PIPED = [
    (None, "a good document of a null id with enough different words to pass every rule here"), (None, "bad"), (7, "another good document whose id is shared and which has enough words to pass it"),
    (7, "bad"), (8, None), (9, "a good document of a null id with enough different words to pass every rule here"), (None, "a good document of a null id with enough different words to pass every rule here"),
]


def test_pipeline_keeps_good_rows_of_null_and_shared_ids(spark, tmp_path):
    import corpus_pipeline as C

    path = f"file://{tmp_path}"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in PIPED], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    spark.createDataFrame([(1, "no words of this item occur anywhere in these documents at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    good = [(d, t) for d, t in PIPED if t and t != "bad"]
    judged = C.quality(spark, docs, path)
    assert judged.columns == docs.columns and sorted(((r.doc_id, r.text) for r in judged.collect()), key=repr) == sorted(good, key=repr)
    single = C.line_dedup(spark, judged, path)
    assert single.columns == docs.columns and sorted(r.text for r in single.collect() if r.text) == sorted([PIPED[0][1], PIPED[2][1]])
    near = C.near_dedup(spark, judged, path)
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted(good, key=repr)  # null ids are linked with nothing
    clean = C.decontamination(spark, judged, path)
    assert clean.columns == docs.columns and clean.count() == len(good)
    for stage in (C.quality, C.line_dedup, C.near_dedup, C.decontamination):
        assert stage(spark, docs.limit(0), path).collect() == []
    assert C.tokenization(spark, judged, path).count() == len(good)


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert C.ORACLE_SQL is None
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(d, t) for (d, t, _), (_, kept) in zip(docs, B.host_verdicts(docs)) if kept]
    gone = B.lines(rows)
    rows = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows]
    kept = {x[0] for x in B.near(rows, 80) if x[3]}
    rows = [r for r in rows if r[0] in kept]
    hit = {x[0] for x in B.contaminated(rows, items) if x[2]}
    rows = [r for r in rows if r[0] not in hit]
    got = {r.doc_id: r.decoded_sha256 for r in C.run(spark, sf).collect()}
    assert got == {d: B.sha(t.encode()) for d, t in rows}
