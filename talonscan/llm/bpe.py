"""Byte-level BPE encoding and decoding by a pair occurrence index.

A text is cut at single spaces and line breaks, where a token always begins, and a word is cut from the marks
behind it; equal parts are encoded once for each task. Cutting, and looking parts up, is done in Arrow over a group of texts. The words of all new parts
of a group are laid in one sequence; an index maps
each pair to all its positions there; active ranks are taken in ascending order from a heap, every
occurrence of the pair is merged from left to right, and the lists of the pairs beside it are updated.

Defined results: null text is the empty text (no tokens); repeated rows give repeated results; special
strings in a text become their special id; other columns are ignored; an empty table gives no rows. There is no
shuffle; memory is one Arrow batch of texts, some 30 bytes for each character of a group, and a cache of at most
``CACHE_BYTES``, emptied when full; parts longer than ``LONG`` bytes are not kept in it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of parts and ids that a task remembers.
CACHE_BYTES = 64 << 20
#: Longest part that is remembered, in bytes.
LONG = 256
#: Texts are taken in groups of about so many bytes; a longer text is taken in slices.
GROUP_BYTES = 4 << 20
#: Parts that the library encodes in one call.
TOGETHER = 256
#: Cuts are safe where a lone space or line break stands between other characters.
_LONE = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(\n)(?=\S)")
#: Texts that match are cut by ``pieces``: neighbouring blanks, or blanks and controls other than space and line break. (RE2 syntax.)
_ODD = r"[ \n][ \n]|[\t\r\f\v\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: One word of Latin letters. (RE2 syntax.)
_WORD = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"
#: A word of Latin letters and the marks behind it; a token begins at the marks. (RE2 syntax.)
_MARKED = r"^(?P<head> ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<tail>[.,;:!?]+)$"


def pieces(text: str) -> list[str]:
    """Parts of the text, in order, that encode on their own."""
    out = []
    at = 0
    for m in _LONE.finditer(text):
        if m.start() > at:
            out.append(text[at : m.start()])
        at = m.start()
        if m[1]:
            out.append("\n")
            at += 1
    out.append(text[at:])
    return out


def slices(text: str, size: int = GROUP_BYTES) -> list[str]:
    """Consecutive parts of about ``size`` characters, cut where a token begins; one part where there is no such place."""
    out, at = [], 0
    while len(text) - at > size and (m := _LONE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class PairIndexBpe:
    """Vocabulary and merges of a tokenizers file; ``encode`` takes many words at once."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.wide = max(vocab.values()) + 1
        self.pairs = []  # by rank: left, right, merged
        self.rank_of = {}  # by left * wide + right
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank_of.setdefault(vocab[a] * self.wide + vocab[b], rank)
        keys = self.byte_id[:, None] * self.wide + self.byte_id
        self.byte_rank = np.array([[self.rank_of.get(k, -1) for k in row] for row in keys.tolist()], np.int64)
        back = {c: b for b, c in letters.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.token_size = np.array([len(t) for t in self.token_bytes], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_data = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.added = added
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(public_tokenizers.PATTERN)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids end to end): one sequence over all words, and a pair occurrence index over it."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.arange(len(raw)) + 1 + np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        n = len(raw) + len(words) + 1
        first = np.full(n, -1, np.int64)  # words stand between -1; no pair goes over it
        first[at] = self.byte_id[raw]
        rank = np.full(n, -1, np.int64)
        rank[at[:-1]] = np.where(at[1:] == at[:-1] + 1, self.byte_rank[raw[:-1], raw[1:]], -1)
        found = np.flatnonzero(rank >= 0)
        found = found[np.argsort(rank[found], kind="stable")]
        kinds, begin = np.unique(rank[found], return_index=True)
        where = dict(zip(kinds.tolist(), (x.tolist() for x in np.split(found, begin[1:]))))
        ids, nxt, prv = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = sorted(where)
        rank_of, pairs, wide, push = self.rank_of.get, self.pairs, self.wide, heapq.heappush
        while ranks:
            a, b, merged = pairs[r := heapq.heappop(ranks)]
            spots = where.pop(r)
            spots.sort()
            high = merged * wide
            for i in spots:
                if ids[i] != a or ids[j := nxt[i]] != b:
                    continue
                ids[i], ids[j] = merged, -2
                k = nxt[i] = nxt[j]
                prv[k] = i
                if (found := rank_of(high + c)) is not None if (c := ids[k]) >= 0 else False:
                    if (held := where.get(found)) is None:
                        where[found] = [i]
                        push(ranks, found)
                    else:
                        held.append(i)
                h = prv[i]
                if (found := rank_of(c * wide + merged)) is not None if (c := ids[h]) >= 0 else False:
                    if (held := where.get(found)) is None:
                        where[found] = [h]
                        push(ranks, found)
                    else:
                        held.append(h)
        done = np.array(ids, np.int64)
        kept = done >= 0
        count = np.concatenate([[0], np.cumsum(kept)])
        return np.diff(count[np.append(ends + np.arange(len(words)) + 1, n)[:-1]], prepend=0), done[kept].astype("<u4")

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number) of each part's ids, and the ids."""
        simple = pc.match_substring_regex(parts, _WORD).to_numpy(zero_copy_only=False)
        words = parts.filter(pa.array(simple)).cast(pa.large_binary()).to_pylist()
        at, plan = {w: k for k, w in enumerate(words)}, []
        for p in parts.filter(pa.array(~simple)).to_pylist():
            row = []
            for n, seg in enumerate(self.split_added.split(p) if self.split_added and "<" in p else [p]):
                if n % 2:
                    row.append(-self.added[seg])
                elif seg:
                    row.extend(at.setdefault(w.encode(), len(at)) for w in self.words.findall(seg))
            plan.append(row)
        number, ids = self.encode_words(list(at)) if at else (np.zeros(0, np.int64), np.zeros(0, "<u4"))
        start, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        begin = np.cumsum(number) - number
        start[simple], size[simple] = begin[: len(words)], number[: len(words)]
        more, base = [], len(ids)
        for k, row in zip(np.flatnonzero(~simple).tolist(), plan):
            ones = [np.array([-w], "<u4") if w < 0 else ids[begin[w] : begin[w] + number[w]] for w in row]
            start[k], size[k] = base, sum(map(len, ones))
            base += int(size[k])
            more += ones
        return start, size, np.concatenate([ids, *more])

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Texts, in UTF-8, of ids end to end."""
        size = self.token_size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        raw = self.token_data[np.repeat(self.token_start[ids] - at[:-1], size) + np.arange(at[-1])].tobytes()
        out, a = [], 0
        for b in at[ends].tolist():
            one, a = raw[a:b], b
            try:
                one.decode()
            except UnicodeDecodeError:
                one = one.decode(errors="replace").encode()
            out.append(one)
        return out

    def decode(self, ids: bytes) -> bytes:
        """Text of little-endian unsigned 32-bit ids, in UTF-8."""
        flat = np.frombuffer(ids, "<u4")
        return self.decode_many(flat, np.array([len(flat)]))[0]


@lru_cache(maxsize=2)
def pair_index(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


class LibraryBpe:
    """The tokenizers library, encoding many parts in one call."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        vocab, letters = t.get_vocab(), byte_letters()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # tokens that open with a blank
        for token, i in vocab.items():
            self.opens[i] = token.startswith(letters[ord(" ")])
        self.breaks = np.zeros(len(self.opens), bool)
        if letters[ord("\n")] in vocab:
            self.breaks[vocab[letters[ord("\n")]]] = True
        added = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number) of each part's ids, and the ids. Parts that open with a blank are encoded side by side, others as lines of one text, where ids then tell them apart."""
        start, size = np.zeros(len(parts), np.int64), np.full(len(parts), -1)
        held, base = [np.zeros(0, "<u4")], 0
        led = pc.starts_with(parts, " ").to_numpy(zero_copy_only=False)
        plain = ~led & ~pc.match_substring_regex(parts, r"\s").to_numpy(zero_copy_only=False) & (pc.binary_length(parts).to_numpy(zero_copy_only=False) > 0)
        for rows, between, marks in ((np.flatnonzero(led), "", self.opens), (np.flatnonzero(plain), "\n", self.breaks)):
            if not len(rows):
                continue
            edges = np.append(np.arange(0, len(rows), TOGETHER), len(rows))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts.take(pa.array(rows))), pa.scalar(between, parts.type)).to_pylist()
            use = [k for k, x in enumerate(texts) if not (self.special and self.special.search(x))]
            for k, ids in zip(use, self._run([texts[k] for k in use])):
                at, n = np.flatnonzero(marks[ids]), int(edges[k + 1] - edges[k])
                if len(at) != n - len(between):
                    continue  # a part has a token of its own that looks like a mark
                mine = rows[edges[k] : edges[k + 1]]
                begin = at if not between else np.concatenate([[0], at + 1])
                start[mine] = base + begin
                size[mine] = np.append(begin[1:] - len(between), len(ids)) - begin
                held.append(ids)
                base += len(ids)
        rest = np.flatnonzero(size < 0)
        for k, ids in zip(rest.tolist(), self._run(parts.take(pa.array(rest)).to_pylist())):
            start[k], size[k] = base, len(ids)
            held.append(ids)
            base += len(ids)
        return start, size, np.concatenate(held)


@lru_cache(maxsize=2)
def library_bpe(path: str) -> LibraryBpe:
    return LibraryBpe(path)


@lru_cache(maxsize=2)
def task_encoder(path: str, library: bool) -> Encoder:
    """The encoder of this worker process; its cache, bounded in bytes, serves later tasks too."""
    return Encoder(library_bpe(path) if library else pair_index(path))


class Encoder:
    """Texts to ids; equal parts are encoded once. ``model`` has ``encode_parts`` and ``special``."""

    def __init__(self, model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.keys = pa.array([""], pa.large_string())
        self.start, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def __call__(self, texts):
        """Yields the ids of each text as bytes, in order."""
        for ids, ends in self.groups(texts):
            raw, a = ids.tobytes(), 0
            for b in ends.tolist():
                yield raw[4 * a : 4 * b]
                a = b

    def groups(self, texts):
        """Yields (ids of consecutive texts end to end, end of each text)."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        a, total = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if n > GROUP_BYTES or total + n > GROUP_BYTES:
                if k > a:
                    yield self._group(texts.slice(a, k - a))
                a, total = k, 0
            total += n
            if n > GROUP_BYTES:
                parts = [self._group(pa.array([x], pa.large_string()))[0] for x in slices(texts[k].as_py())]
                ids = np.concatenate(parts)
                yield ids, np.array([len(ids)])
                a, total = k + 1, 0
        if a < len(texts):
            yield self._group(texts.slice(a))

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The parts of each text."""
        odd = pc.match_substring_regex(texts, _ODD)
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(rows):
            return cut
        by_hand = pa.array([pieces(x) for x in texts.take(pa.array(rows)).to_pylist()], cut.type)
        order = np.arange(len(texts))
        order[rows] = len(texts) + np.arange(len(rows))
        return pa.concat_arrays([cut, by_hand]).take(pa.array(order))

    def _group(self, texts: pa.Array):
        cut = self._cut(texts)
        flat = cut.flatten().dictionary_encode()
        found = pc.index_in(flat.dictionary, value_set=self.keys)
        new = flat.dictionary.filter(pc.is_null(found))
        row = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row[row < 0] = len(self.keys) + np.arange(len(new))
        start, size, ids = self.start, self.size, self.ids
        if len(new):
            more_size, more_ids = self._encode(new)
            start = np.concatenate([start, len(ids) + np.cumsum(more_size) - more_size])
            size, ids = np.concatenate([size, more_size]), np.concatenate([ids, more_ids])
            self._remember(new, more_size, more_ids)
        at = row[flat.indices.to_numpy(zero_copy_only=False)]
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = cut.offsets.to_numpy()
        return out, ends[bounds[1:] - bounds[0]]

    def _encode(self, new: pa.Array):
        """(number of ids of each, ids end to end); a word is encoded once for all marks behind it."""
        marked = pc.extract_regex(new, _MARKED)
        split = marked.is_valid()
        if self.model.special:
            split = pc.and_(split, pc.invert(pc.match_substring_regex(new, self.model.special.pattern)))
        split = split.to_numpy(zero_copy_only=False)
        heads = pc.struct_field(marked, "head").filter(pa.array(split))
        tails = pc.struct_field(marked, "tail").filter(pa.array(split))
        every = pa.concat_arrays([new.filter(pa.array(~split)), heads, tails]).dictionary_encode()
        known = pc.index_in(every.dictionary, value_set=self.keys)
        missing = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        got_start, got_size, got = self.model.encode_parts(every.dictionary.take(pa.array(missing)))
        rows = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows[missing] = len(self.keys) + np.arange(len(missing))
        start = np.concatenate([self.start, len(self.ids) + got_start])
        size, ids = np.concatenate([self.size, got_size]), np.concatenate([self.ids, got])
        at = rows[every.indices.to_numpy(zero_copy_only=False)]
        k, m = int((~split).sum()), int(split.sum())
        pair = np.zeros((len(new), 2), np.int64)  # row 0 is the empty part
        pair[~split, 0], pair[split, 0], pair[split, 1] = at[:k], at[k : k + m], at[k + m :]
        flat = pair.ravel()
        n = size[flat]
        ends = np.cumsum(n)
        return n.reshape(-1, 2).sum(axis=1), ids[np.repeat(start[flat] - (ends - n), n) + np.arange(n.sum())]

    def _remember(self, new: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        short = pc.binary_length(new).to_numpy(zero_copy_only=False) <= LONG
        if not short.all():
            new, ids, size = new.filter(pa.array(short)), ids[np.repeat(short, size)], size[short]
        if self.keys.nbytes + 4 * len(self.ids) + new.nbytes + 4 * len(ids) + 16 * (len(self.keys) + len(new)) > CACHE_BYTES:
            self._clear()
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        self.keys = pa.concat_arrays([self.keys, new])


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded as UTF-8 bytes."""
    return _coded(docs, tokenizer, "ids binary, decoded binary", lambda ids, raw: (ids, raw))


def _coded(docs: DataFrame, tokenizer: str | None, columns: str, shape) -> DataFrame:
    path = tokenizer or tokenizer_path()
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches):
        bpe, encode = pair_index(path), task_encoder(path, False)
        for batch in batches:
            n, a, b = [], [], []
            for ids, ends in encode.groups(batch.column(1)):
                raw, at = ids.tobytes(), 0
                for end, text in zip(ends.tolist(), bpe.decode_many(ids, ends)):
                    x, y = shape(raw[4 * at : 4 * end], text)
                    n.append(end - at)
                    a.append(x)
                    b.append(y)
                    at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, n_tokens bigint, {columns}")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda ids, raw: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest())
    return _coded(docs, None, "ids_sha256 string, decoded_sha256 string", digest).select(
        "doc_id", F.col("n_tokens").cast("long"), "ids_sha256", "decoded_sha256"
    )
