"""Exact removal of repeated 100-byte strings by blockwise suffix sorting with a difference cover.

A window is ``SPAN`` bytes. Every window is filed under an anchor: the position of the smallest ``K``-gram hash in it,
so equal windows have equal anchors at equal offsets. Windows of consecutive starts with one anchor form a context.

1. Contexts are grouped by their anchor's K-gram. One seen before in full (by two 64-bit hashes) repeats as a whole; a
   K-gram seen once has no repeat. Only contexts that share a K-gram but differ go on, as they may repeat in part.
2. Their bytes are fetched from the documents.
3. In each block of whole groups, the windows are suffixes of one byte sequence in which anchors are aligned to the
   cover's modulus. Ranks of the suffixes at cover positions are computed first, by doubling. Suffixes are sorted one bucket (start
   modulo ``V``) at a time, by the bytes up to the next cover position and then by its rank, which settles
   long ties without comparing further. Neighbours that share ``SPAN`` bytes are equal, and all but the first
   in document order are repeats. Memory is bounded by the block, as no group is larger than about ``GROUP_ROWS`` (4.).
4. K-grams that a sample of documents shows to be very common are dealt to several groups by document already in step 1, so that its
   sort is even; after it every group of more than ``GROUP_ROWS`` contexts, counted over all, is dealt to several. What each of these groups holds first is
   then matched across groups by a 128-bit hash. The sample only decides how work is dealt, never the result. Step 1 holds a K-gram's
   rows (32 bytes each) together; one that the sample misses has less than about one for each 200 documents.

Defined results: null text is empty; documents are ordered by doc_id (nulls first), repeated ids in order of a
hash of their text; matches do not cross documents; other columns are carried through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import complete_groups, materialize, release_shuffles, table

SPAN = 100
K = 32
W = SPAN - K + 1
V = 32
#: Bytes that the anchor search takes at a time, and contexts that a suffix block holds.
SLICE = 1 << 21
BLOCK = 40_000
#: Documents of the sample that finds common K-grams, and rows that one of their groups should hold.
SAMPLE_DOCS = 4000
GROUP_ROWS = 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)


def difference_cover(v: int) -> list[int]:
    """Residues such that any two positions have a common distance below v to residues of the set; found greedily."""
    cover, missing = [0, 1], set(range(2, v - 1))
    while missing:
        best = max((c for c in range(v) if c not in cover), key=lambda c: len({(s * (c - d)) % v for d in cover for s in (1, -1)} & missing))
        missing -= {(s * (best - d)) % v for d in cover for s in (1, -1)}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(V)
#: For each residue, the distance to the next cover position.
TO_COVER = [min((d - r) % V for d in COVER) for r in range(V)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def contexts(data: np.ndarray, ends: np.ndarray):
    """Contexts of documents laid end to end: (document, first window, windows, anchor offset, K-gram hash, context hash)."""
    n = len(data)
    if n < SPAN:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    h = {1: _LETTERS[data]}
    for k in (1, 2, 4, 8, 16, 32):
        h[2 * k] = h[k][: len(h[k]) - k] + _power(k) * h[k][k:]
    m = n - SPAN + 1
    window = h[64][:m] + _power(64) * h[32][64 : 64 + m] + _power(96) * h[4][96 : 96 + m]
    gram = _mix(h[K])
    best = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= W:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    best = np.minimum(best[:m], best[W - width : W - width + m])
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:m]
    valid = ends[doc] - np.arange(m) >= SPAN
    change = np.empty(m, bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(change)
    hi = np.append(lo[1:], m) - 1
    use = valid[lo]
    lo, hi = lo[use], hi[use]
    count, offset = hi - lo + 1, anchor[lo] - lo
    whole = _mix(_mix(window[lo]) + np.uint64(3) * window[hi] + (count * 256 + offset).astype(np.uint64))
    start = (ends - np.diff(ends, prepend=0))[doc[lo]]
    return [doc[lo], lo - start, count, offset, gram[anchor[lo]], whole]


def _sliced(texts: list[bytes | None]):
    """Groups of (row, base, bytes) of about SLICE bytes; a longer text is taken in slices of windows."""
    group, size = [], 0
    for row, t in enumerate(texts):
        t = t or b""
        for a in range(0, max(len(t) - SPAN + 1, 0), SLICE):
            part = t[a : a + SLICE + SPAN - 1]
            group.append((row, a, part))
            size += len(part)
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchored(docs: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(ord, text binary) to context rows (gid, whole, ord, packed)."""
    hot_gram = np.array(sorted(hot), np.uint64)
    hot_parts = np.array([hot[g] for g in sorted(hot)], np.uint64)

    def run(batches):
        for batch in batches:
            order = batch.column(0).to_numpy(zero_copy_only=False)
            for group in _sliced(batch.column(1).to_pylist()):
                data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
                doc, lo, count, offset, gram, whole = contexts(data, np.cumsum([len(p) for _, _, p in group]))
                ords = order[np.array([r for r, _, _ in group])[doc]]
                lo = lo + np.array([a for _, a, _ in group])[doc]
                is_hot = np.zeros(len(lo), bool)
                if len(hot_gram):
                    k = np.minimum(np.searchsorted(hot_gram, gram), len(hot_gram) - 1)
                    is_hot = hot_gram[k] == gram
                    salt = _mix(ords.astype(np.int64).view(np.uint64) + np.uint64(11)) % hot_parts[k]
                    gram = np.where(is_hot, _mix(gram + np.uint64(7) + salt), gram)
                packed = (lo << 16) | (count << 9) | (offset << 1) | is_hot
                for a in range(0, len(lo), 50_000):
                    b = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram[b].view(np.int64)), pa.array(whole[b].view(np.int64)), pa.array(ords[b].astype(np.int64)), pa.array(packed[b])],
                        ["gid", "whole", "ord", "packed"],
                    )

    return docs.select("ord", "text").mapInArrow(run, "gid bigint, whole bigint, ord bigint, packed bigint")


def sift(batches):
    """Sorted context rows to (kind, gid, ord, packed): kind 0 repeats as a whole, kind 1 may repeat in part."""

    def take(t):
        gid, whole, order, packed = (t.column(k).to_numpy() for k in range(4))
        new_group = np.concatenate([[True], gid[1:] != gid[:-1]])
        first = new_group | np.concatenate([[True], whole[1:] != whole[:-1]])
        group = np.cumsum(new_group) - 1
        kinds = np.bincount(group[first], minlength=group[-1] + 1)
        maybe = first & ((kinds[group] > 1) | (packed & 1 == 1))
        out = ~first | maybe
        yield pa.RecordBatch.from_arrays(
            [pa.array(maybe[out].astype(np.int32)), pa.array(gid[out]), pa.array(order[out]), pa.array(packed[out])], ["kind", "gid", "ord", "packed"]
        )

    yield from complete_groups(batches, 200_000, take)


def equal_windows(data: np.ndarray, starts: np.ndarray):
    """Class of each window start: windows of SPAN equal bytes have one class. Starts that are equal must agree modulo V.

    ``data`` has at least 3 * SPAN bytes after the last start.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for b in range(8):
        word = (word << np.uint64(8)) | padded[b : b + len(data)]
    # ranks of the suffixes at cover positions, over V, 2V and 4V bytes
    last = len(data) - 4 * V - 8
    at = np.arange(0, last)
    at = at[np.isin(at % V, COVER)]
    keys = [word[at + 8 * k] for k in range(V // 8)]
    order = np.lexsort(keys[::-1])
    rank = np.zeros(len(at), np.int64)
    differs = np.zeros(len(at), bool)
    for k in keys:
        differs[1:] |= k[order][1:] != k[order][:-1]
    rank[order] = np.cumsum(differs)
    index = np.full(len(data) + 4 * V, -1, np.int64)
    index[at] = np.arange(len(at))
    for step in (V, 2 * V):
        other = index[at + step]
        both = np.where(other >= 0, rank[other] + 1, 0)
        order = np.lexsort((both, rank))
        a, b = rank[order], both[order]
        new = np.zeros(len(at), np.int64)
        new[order] = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(at) else 0
        rank = new
    out = np.zeros(len(starts), np.int64)
    classes = 0
    residue = starts % V
    for r in range(V):  # one suffix bucket at a time
        rows = np.flatnonzero(residue == r)
        if not len(rows):
            continue
        i = starts[rows]
        d = TO_COVER[r]
        keys = [word[i + 8 * k] for k in range((d + 7) // 8)] + [rank[index[i + d]]]
        i_sorted = np.lexsort(keys[::-1])
        s = i[i_sorted]
        same = np.ones(len(s) - 1, bool)
        for b in [*range(0, SPAN - 8, 8), SPAN - 8]:
            w = word[s + b]
            same &= w[1:] == w[:-1]
        label = np.concatenate([[0], np.cumsum(~same)])
        out[rows[i_sorted]] = classes + label
        classes += int(label[-1]) + 1
    return out


def sort_blocks(batches):
    """Rows (gid, ord, packed, bytes) sorted by gid to (ord, lo, n, digest): n windows from lo repeat; with digest, a common window first seen here."""

    def take(t):
        order, packed = t.column(1).to_numpy(), t.column(2).to_numpy()
        parts = t.column(3).to_pylist()
        lo, count, offset, hot = packed >> 16, (packed >> 9) & 127, (packed >> 1) & 255, packed & 1
        spot, at = np.zeros(len(parts), np.int64), 0
        for k, off in enumerate(offset.tolist()):
            at += -(at + off) % V  # anchors are aligned
            spot[k] = at
            at += len(parts[k])
        data = np.zeros(at + 4 * SPAN, np.uint8)
        for a, p in zip(spot.tolist(), parts):
            data[a : a + len(p)] = np.frombuffer(p, np.uint8)
        ctx = np.repeat(np.arange(len(parts)), count)
        within = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
        label = equal_windows(data, spot[ctx] + within)
        place = np.zeros(len(parts), np.int64)
        place[np.lexsort((lo, order))] = np.arange(len(parts))
        key = place[ctx] * 128 + within
        earliest = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, label, key)
        dup = key > earliest[label]
        d = np.flatnonzero(dup)
        if len(d):
            begin = np.concatenate([[True], (np.diff(d) != 1) | (ctx[d[1:]] != ctx[d[:-1]])])
            b = d[begin]
            size = np.diff(np.append(np.flatnonzero(begin), len(d)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[ctx[b]]), pa.array(lo[ctx[b]] + within[b]), pa.array(size), pa.nulls(len(b), pa.binary())], ["ord", "lo", "n", "digest"]
            )
        f = np.flatnonzero(~dup & (hot[ctx] == 1))
        for a in range(0, len(f), 50_000):
            g = f[a : a + 50_000]
            digests = [xxhash.xxh3_128_digest(parts[c][w : w + SPAN]) for c, w in zip(ctx[g].tolist(), within[g].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[ctx[g]]), pa.array(lo[ctx[g]] + within[g]), pa.array(np.ones(len(g), np.int64)), pa.array(digests, pa.binary())],
                ["ord", "lo", "n", "digest"],
            )

    yield from complete_groups(batches, BLOCK, take)


def _cut_contexts(batches):
    """(text, array of (gid, packed), ord) to (gid, ord, packed, bytes)."""
    for batch in batches:
        wanted = batch.column(1)
        flat = wanted.flatten()
        gid, packed = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        sizes = np.diff(wanted.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        ords = batch.column(2).to_numpy(zero_copy_only=False)[row]
        texts = batch.column(0).to_pylist()
        for a in range(0, len(row), 20_000):
            s = slice(a, a + 20_000)
            lo, count = packed[s] >> 16, (packed[s] >> 9) & 127
            parts = [texts[r][x : x + n + SPAN - 1] for r, x, n in zip(row[s].tolist(), lo.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(gid[s]), pa.array(ords[s]), pa.array(packed[s]), pa.array(parts, pa.binary())], ["gid", "ord", "packed", "bytes"])


def common_grams(docs: DataFrame, n_docs: int) -> dict[int, int]:
    """K-gram hash to a number of groups, for those that many documents of a sample hold; at most one for each 20 contexts of the sample."""
    share = min(1.0, SAMPLE_DOCS / max(n_docs, 1))
    picked = docs.sample(share, 7) if share < 1 else docs
    often = anchored(picked, {}).groupBy("gid").agg(F.count("*").alias("n")).where("n >= 20").collect()
    out = {}
    for r in often:
        parts = -(-int(r.n / share) // GROUP_ROWS)
        if parts > 1:
            out[int(np.int64(r.gid).view(np.uint64))] = parts
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """(ord, text binary) with distinct ord to (ord, lo, n): the n windows from lo on also start earlier."""
    spark = docs.sparkSession
    hot = common_grams(docs, docs.select("ord").count())
    rows = anchored(docs, hot).repartition("gid").sortWithinPartitions("gid", "whole", "ord", "packed")
    sifted = materialize(rows.mapInArrow(sift, "kind int, gid bigint, ord bigint, packed bigint"), "sifted")
    release_shuffles(spark)
    windows = F.shiftright("packed", 16).alias("lo"), F.shiftright("packed", 9).bitwiseAND(F.lit(127)).alias("n")
    whole = sifted.where("kind = 0").select("ord", *windows)
    part = sifted.where("kind = 1").select("gid", "ord", "packed")
    large = part.groupBy(F.col("gid").alias("_g")).agg(F.count("*").alias("n")).where(f"n > {GROUP_ROWS}")
    large = materialize(large.select("_g", F.ceil(F.col("n") / GROUP_ROWS).alias("parts")), "large")
    if large.limit(1).count():
        hot = hot or {0: 0}
        many = F.col("parts").isNotNull()
        part = part.join(large, F.col("gid") == F.col("_g"), "left").select(
            F.when(many, F.xxhash64("gid", F.pmod(F.xxhash64("ord", "packed"), F.col("parts")))).otherwise(F.col("gid")).alias("gid"),
            "ord",
            F.when(many, F.col("packed").bitwiseOR(F.lit(1))).otherwise(F.col("packed")).alias("packed"),
        )
    wanted = part.groupBy(F.col("ord").alias("_o")).agg(F.collect_list(F.struct("gid", "packed")).alias("wanted"))
    fetched = docs.join(wanted, F.col("ord") == F.col("_o")).select("text", "wanted", "ord").mapInArrow(
        _cut_contexts, "gid bigint, ord bigint, packed bigint, bytes binary"
    )
    solved = materialize(
        fetched.repartition("gid").sortWithinPartitions("gid").mapInArrow(sort_blocks, "ord bigint, lo bigint, n bigint, digest binary"), "solved"
    )
    release_shuffles(spark)
    out = whole.unionByName(solved.where("digest is null").select("ord", "lo", "n"))
    if hot:
        firsts = solved.where("digest is not null")
        seen = firsts.groupBy(F.col("digest").alias("_d")).agg(F.min(F.struct("ord", "lo")).alias("first"), F.count("*").alias("times")).where("times > 1")
        again = firsts.join(seen, F.col("digest") == F.col("_d")).where(F.struct("ord", "lo") > F.col("first")).select("ord", "lo", "n")
        out = out.unionByName(again)
    return out


def _ordered(docs: DataFrame) -> DataFrame:
    """(ord, doc_id, text, rest): a distinct ``ord`` in document order, doc_id itself where that is distinct; rest is a struct of all columns but text."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not twice:
        return docs.select(F.col("doc_id").alias("ord"), "doc_id", "text", rest)
    rows = docs.select("doc_id", "text", rest).withColumn("h", F.xxhash64("text"))
    sorted_ = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return materialize(sorted_.select(F.monotonically_increasing_id().alias("ord"), "doc_id", "text", "rest"), "ordered")


def _apply(docs: DataFrame, columns: str, shape) -> DataFrame:
    """docs with ord to (ord, doc_id, *columns), shape taking text bytes and a mask of removed bytes (None: none)."""
    texts = docs.select("ord", "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = repeats(texts.select("ord", "text")).groupBy(F.col("ord").alias("_o")).agg(
        F.collect_list(F.struct("lo", "n")).alias("runs")
    )
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches):
        for batch in batches:
            out = []
            runs = batch.column(3)
            flat = runs.flatten()
            lo, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(runs), 0).to_numpy())])
            for k, text in enumerate(batch.column(2).to_pylist()):
                mask = None
                if at[k + 1] > at[k]:
                    a, c = lo[at[k] : at[k + 1]], n[at[k] : at[k + 1]]
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + c + SPAN - 1, -1)
                    mask = np.cumsum(edge)[:-1] > 0
                out.append(shape(text, mask))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, zip(*out))], ["ord", "doc_id", *names])

    both = texts.join(found, F.col("ord") == F.col("_o"), "left").select("ord", "doc_id", "text", "runs")
    return both.where("ord is not null").mapInArrow(run, f"ord bigint, doc_id bigint, {columns}")


def _kept(text: bytes, mask) -> bytes:
    return text if mask is None else np.frombuffer(text, np.uint8)[~mask].tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with text less its repeated bytes (and n_chars to match); characters cut in part go whole."""
    rows = _ordered(docs)
    done = _apply(rows, "clean string", lambda t, m: (_kept(t, m).decode("utf-8", "ignore"),)).select(F.col("ord").alias("_ord"), "clean")
    rest = rows.select("ord", "rest").join(done, F.col("ord") == F.col("_ord"))
    changed = {"text": F.when(F.col("clean") != "", F.col("clean")).otherwise(F.lit(""))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return rest.select(*[changed[c].alias(c) if c in changed else F.col("rest")[c].alias(c) for c in docs.columns])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shape(text, mask):
        spans = 0 if mask is None else int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
        return len(text), 0 if mask is None else int(mask.sum()), spans, hashlib.sha256(_kept(text, mask)).hexdigest()

    docs = _ordered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _apply(docs, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", shape).drop("ord")
