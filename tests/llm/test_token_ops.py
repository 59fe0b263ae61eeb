"""BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from talonscan.llm import bpe, packing, token_files
from tests.llm.edge import ROWS, frame, saved

SF = "/root/testdata/sf0.001"
TEXTS = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encode_fuzz(library):
    random.seed(3)
    letters = list("ab'sre 1½²٣ \n\t\r\x1c\x85 é😀.,ß中") + ["<|endoftext|>", "  ", "'ll"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    index = bpe.pair_index(bpe.tokenizer_path())
    for t, ids in zip(texts, bpe.Encoder(index)(texts)):
        assert ids == ids_of(library, t), repr(t)
        assert index.decode(ids).decode() == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_op2(spark, tmp_path, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for folder, texts in ((saved(spark, tmp_path), TEXTS), (SF, docs)):
        rows = bpe.op2_bpe(spark, folder).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = ids_of(library, texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def test_op4(spark, tmp_path, library):
    rows = token_files.op4_token_files(spark, saved(spark, tmp_path)).collect()
    at = 0
    assert len(rows) == len(TEXTS)
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = ids_of(library, TEXTS[r.doc_id]) + np.array([2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    manifest = token_files.write_tokens(frame(spark, ROWS), f"file://{tmp_path}/tok").collect()
    found = 0
    for m in manifest:
        with open(m.path, "rb") as f:
            reader = token_files.TokenReader(f, f.seek(0, 2))
            for ids in reader.find(8):
                found += 1
                assert ids.tobytes()[:-4] == ids_of(library, TEXTS[8])
    assert found == 1
    m = max(manifest, key=lambda m: m.n_tokens)
    raw = bytearray(open(m.path, "rb").read())
    import io

    raw[token_files.TokenReader(io.BytesIO(bytes(raw)), len(raw)).frame_at[1] - 5] ^= 1  # in the first frame
    reader = token_files.TokenReader(io.BytesIO(bytes(raw)), len(raw))
    with pytest.raises(Exception):
        reader.frame(0)
    empty = token_files.write_tokens(frame(spark, []), f"file://{tmp_path}/none")
    assert token_files.read_tokens(spark, empty, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("histogram", [{1024: 5}, {100: 1000}, {1: 3000}, {513: 10, 511: 10}, {n: 3 for n in range(1, 1025)}, {}])
def test_patterns(histogram):
    packs = packing.patterns(histogram)
    placed = defaultdict(int)
    for count, pack in packs:
        assert count > 0 and sum(pack) <= 1024
        for n in pack:
            placed[n] += count
    assert dict(placed) == histogram
    total, used = sum(k * n for k, n in histogram.items()), sum(c for c, _ in packs)
    assert used <= total / 1024 * 1.1 + 2


def check_packed(rows, texts, library):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = ids_of(library, texts[d] or "") + np.array([0], "<u4").tobytes()
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) * 1024 <= 1.05 * sum(r.length for r in rows) + 2048


def test_op6(spark, tmp_path, library):
    check_packed(packing.op6_packing(spark, saved(spark, tmp_path)).collect(), TEXTS, library)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packed(packing.op6_packing(spark, SF).collect(), docs, library)
    assert packing.pack(frame(spark, [])).count() == 0
    packed = packing.pack(frame(spark, ROWS[5:]), with_ids=True)
    seqs = {r.sequence_id: r for r in packing.assemble(packed).collect()}
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        row = seqs[r.sequence_id]
        assert row.ids[r.offset : r.offset + r.length] == ids
        assert len(row.ids) == (row.n_tokens if row.n_tokens & (row.n_tokens - 1) == 0 else 1024)


def test_parts_side_by_side(library):
    """Parts of every sort, some with inner blanks or special strings, encode as each does alone, in both models."""
    import pyarrow as pa

    special = [x.content for x in library.get_added_tokens_decoder().values()][:3]
    parts = [f" w{i}ord{i % 7}," for i in range(3 * bpe.TOGETHER)] + [f"Line{i}" for i in range(bpe.TOGETHER + 9)]
    parts += [" a  b", " c\t d", " éè", *[" " + s for s in special], *special, "\n", "x y", "", "don't", "\u0000"]
    for model in (bpe.library_bpe(bpe.tokenizer_path()), bpe.pair_index(bpe.tokenizer_path())):
        start, size, ids = model.encode_parts(pa.array(parts, pa.large_string()))
        for p, a, n in zip(parts, start, size, strict=True):
            assert ids[a : a + n].tobytes() == ids_of(library, p), p


@pytest.mark.parametrize("library_model", [True, False])
def test_encoder_cases(library, library_model, monkeypatch):
    """Odd blanks, controls, marks behind words, apostrophes, long texts in slices, a cache that is emptied, and long parts."""
    monkeypatch.setattr(bpe, "GROUP_BYTES", 3000)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    random.seed(5)
    words = ["word", "Straße,", "don't", "it's.", "a\tb", "x\u0000y", "<|endoftext|>", "end.<|endoftext|>", "...", "3.14,", "«ça»", "×÷", "é!?", "\u3000", "中文。", "o'", "\n", " ", "'ll"]
    texts = [random.choice([" ", "\n", "  "]).join(random.choice(words) + str(random.choice(["", i])) for i in range(n)) for n in (*range(60), 700, 4000)]
    texts += [" ".join(random.choice(words[:4]) for _ in range(5000)), "x" * 20_000, " lead", "trail ", "\nlead", "trail\n", "", None]
    encode = bpe.Encoder(bpe.library_bpe(bpe.tokenizer_path()) if library_model else bpe.pair_index(bpe.tokenizer_path()))
    for _ in range(2):
        got = list(encode(texts))
        assert len(got) == len(texts)
        for t, ids in zip(texts, got):
            assert ids == ids_of(library, t or ""), repr(t)[:200]
    assert encode.keys.nbytes < 20_000


def test_width(spark, tmp_path):
    """Ids over 65,535 take four bytes."""
    m = token_files.write_tokens(frame(spark, [(1, "a b", None, None, None, None)]), f"file://{tmp_path}/wide", end_id=70_000).collect()
    with open(m[0].path, "rb") as f:
        assert token_files.TokenReader(f, f.seek(0, 2)).find(1)[0][-1] == 70_000
