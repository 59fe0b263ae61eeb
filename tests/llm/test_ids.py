"""Null and repeated ids: every row has its result."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from talonscan.llm import bpe, packing, secrets, simhash, token_files
from tests.llm.edge import saved

TEXTS = [(None, "a b token=abcdef1"), (None, "c d e"), (None, "c d e"), (5, "x y deadbeefdeadbeefdeadbeef"), (5, "x y deadbeefdeadbeefdeadbeef"), (5, "another text"), (7, None), (9, "c d e")]


@pytest.fixture
def folder(spark, tmp_path):
    return saved(spark, tmp_path, [(i, t, "en", "s", 1, "x") for i, t in TEXTS])


@pytest.fixture(scope="module")
def ids():
    library = Tokenizer.from_file(bpe.tokenizer_path())
    return lambda text, end=(): np.array([*library.encode(text or "", add_special_tokens=False).ids, *end], "<u4").tobytes()


def test_encoding(spark, folder, ids):
    want = Counter((i, len(ids(t)) // 4, hashlib.sha256(ids(t)).hexdigest()) for i, t in TEXTS)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.op2_bpe(spark, folder).collect()) == want


def test_token_files(spark, folder, ids):
    rows = token_files.op4_token_files(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(ids(t, [2])) // 4, zlib.crc32(ids(t, [2]))) for i, t in TEXTS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert named == sorted(named)


def test_packing(spark, folder, ids):
    rows = packing.op6_packing(spark, folder).collect()
    whole = Counter((r.doc_id, r.length, r.ids_crc32) for r in rows if r.length == r.doc_tokens)
    assert whole == Counter((i, len(ids(t, [0])) // 4, zlib.crc32(ids(t, [0]))) for i, t in TEXTS)


def test_fingerprints(spark, folder):
    rows = simhash.op3_simhash(spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    same = [r for r in rows if r.fingerprint == next(x.fingerprint for x in rows if x.doc_id == 9)]
    assert len(same) == 3 and {r.component_id for r in same} == {9}
    assert sorted(map(str, (r.component_id for r in rows if r.doc_id is None))) == ["9", "9", "None"]


def test_secrets(spark, folder):
    got = Counter((r.doc_id, r.n_assign, r.n_hex, r.spans) for r in secrets.op10_secret_scan(spark, folder).collect())
    want = Counter((i, int("token" in (t or "")), int("dead" in (t or "")), "assign:4:17" if "token" in (t or "") else "hex:4:28" if "dead" in (t or "") else "") for i, t in TEXTS)
    assert got == want
