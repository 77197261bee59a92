"""The registered queries over the standard tables: against their SQL, and against brute force where there is none."""

import glob
import os
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute as B  # noqa: E402

from visorq.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    cols = sorted(got.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    cur = duck.execute(Q.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert mine == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)


def test_op3_digests(spark, texts):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(Q.tokenizer_path()), {}
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[d] = len(ids), B.sha(np.array(ids, "<u4").tobytes()), B.sha(tok.decode(ids, skip_special_tokens=False).encode())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op3_bpe(spark, SF).collect()} == want


def test_op10_digests(spark, texts):
    gone = B.lines(texts)
    want = {}
    for d, t in texts:
        lines = (t or "").split("\n")
        lost = [i for i in range(len(lines)) if (d, i) in gone]
        want[d] = sum(x != "" for x in lines), len(lost), B.sha("\n".join(x for i, x in enumerate(lines) if i not in lost).encode())
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in Q.op10_line_dedup(spark, SF).collect()} == want


def test_op1_spans(spark, texts):
    want = {d: (n, gone, spans, sha) for d, n, gone, spans, sha in B.suffix(texts[:60])}
    from visorq.llm.suffix_dedup import removed_bytes

    got = removed_bytes(spark.createDataFrame(texts[:60], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len([x for x in r.spans.split(",") if x]), B.sha(bytes(r.kept))) for r in got} == want


def test_op7_pseudonyms_are_linked(spark, texts, monkeypatch):
    monkeypatch.setenv("VISORQ_PII_KEY", "a key")
    from visorq.llm import pii

    key = __import__("hashlib").sha256(b"a key").digest()
    got = {r.doc_id: r for r in Q.op7_pii(spark, SF).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        new, found = pii.pseudonymize(t or "", key)
        assert got[d].text == (new if t is not None else None) and got[d].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in found)
