"""Suffix dedup against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from talonscan.llm import suffix_dedup as sd
from tests.llm.edge import ROWS, frame, saved

SF = "/root/testdata/sf0.001"


def slow(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        t = (texts[d] or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(rows, texts):
    want = slow(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def shuffled(n, seed):
    random.seed(seed)
    vocab = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 5))) for _ in range(300)]
    text = lambda k: " ".join(random.choice(vocab) for _ in range(k))
    passages = [text(60) for _ in range(5)]
    rows = []
    for d in range(n):
        p = random.choice(passages)
        cut = random.randint(0, 100)
        body = text(random.randint(0, 60)) + p[cut : cut + random.randint(50, 400)] + text(random.randint(0, 60))
        if random.random() < 0.2:
            body = body + passages[0] + random.choice("xyz") + body
        if random.random() < 0.1:
            body = "ab" * 150 + body + "ab" * 90
        rows.append((d, body, None, None, 1, None))
    return rows


def test_op7(spark, tmp_path):
    small = [r for r in ROWS if r[0] not in (4, 5)] + [(4, ROWS[3][1][:30_000], None, None, 1, None), (5, ROWS[3][1][:30_050], None, None, 1, None)]
    check(sd.op7_suffix_dedup(spark, saved(spark, tmp_path, small)).collect(), {r[0]: r[1] for r in small})
    check(sd.op7_suffix_dedup(spark, SF).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


@pytest.mark.parametrize("rows, part", [(sd.GROUP_ROWS, sd.SLICE), (7, 500)])
def test_common_passages(spark, tmp_path, monkeypatch, rows, part):
    """The second case deals common K-grams to many groups and cuts texts in slices."""
    monkeypatch.setattr(sd, "GROUP_ROWS", rows)
    monkeypatch.setattr(sd, "SLICE", part)
    data = shuffled(150, rows)
    check(sd.op7_suffix_dedup(spark, saved(spark, tmp_path, data)).collect(), {r[0]: r[1] for r in data})


def test_repeated_ids_and_empty(spark):
    text = " ".join(str(i * i) for i in range(100))
    out = sd.remove_repeats(frame(spark, [(1, text, "en", "s", 1, "x"), (1, text, "en", "s", 1, "y"), (None, text, "en", "s", 1, "z")])).collect()
    assert sorted(len(r.text) for r in out) == [0, 0, len(text)]
    assert next(r.h for r in out if r.text) == "z" and all(r.n_chars == len(r.text) for r in out)
    assert sd.remove_repeats(frame(spark, [])).count() == 0


def test_clashing_names(spark):
    from talonscan.llm import near_copies

    text = "some words of a text that is long enough to repeat " * 5
    df = spark.createDataFrame([(1, text, 9, "c", "o"), (2, text, 8, "d", "p")], "doc_id long, text string, ord int, clean string, _ord string")
    rows = {r.doc_id: r for r in sd.remove_repeats(df).collect()}
    assert (rows[1].ord, rows[1].clean, rows[2]._ord, rows[2].text) == (9, "c", "p", "")
    assert [r.asDict() for r in near_copies.keep_one(df).collect()] == [{"doc_id": 1, "text": text, "ord": 9, "clean": "c", "_ord": "o"}]


def test_large_groups_are_split(spark, monkeypatch):
    """Groups over the limit are dealt anew by their counted size, also where no sample names them; results stay."""
    monkeypatch.setattr(sd, "GROUP_ROWS", 3)
    monkeypatch.setattr(sd, "common_grams", lambda docs, n: {})
    rng = np.random.default_rng(2)
    common = "the very same passage in the middle of all documents, sixty-odd letters or more."
    word = lambda: "".join(map(chr, rng.integers(97, 123, 60)))
    rows = [(i, word() + common + (word() if i % 3 else "x" * 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sd.remove_repeats(df).collect()}
    seen = set()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 99):
            if t[a : a + 100] in seen:
                gone[a : a + 100] = True
            seen.add(t[a : a + 100])
        assert got[i] == "".join(c for c, g in zip(t, gone) if not g)
