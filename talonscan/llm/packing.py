"""Sequence packing: shortest pack first over the length histogram.

Documents are encoded and cut into pieces of at most ``size`` ids. The histogram of piece lengths (at most
``size`` numbers) goes to the driver, where lengths are placed longest first, each into the open packs that are
filled least and still fit it; whole counts of equal packs move at once, so work depends on ``size`` and not on the corpus.
The packing patterns are then joined back: the r-th piece of a length takes the r-th place of that length.

Ranks are global without a global sort: a task numbers its pieces of each length, and the sums of the earlier tasks'
counts are added by a join on (length, task).

Defined results: null text is the empty text and has just the end id; repeated rows are packed each; a null
doc_id is carried; other columns are ignored; an empty table gives no pieces. Every id lies in one piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talonscan.llm.bpe import task_encoder, tokenizer_path
from talonscan.llm.common import materialize, table

SIZE = 1024
END_ID = 0


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs; every length of the histogram is placed exactly as often as it says."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by fill
    full = []

    def put(fill: int, count: int, pack: tuple[int, ...]) -> None:
        (full if fill == size else open_packs[fill]).append((count, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # the least filled packs that existed before this length; each takes as many copies as fit, evenly
        for fill in sorted(f for f in open_packs if open_packs[f] and f + length <= size):
            if not left:
                break
            waiting, open_packs[fill] = open_packs[fill], []
            for count, pack in waiting:
                each = (size - fill) // length
                whole = min(count, left // each)
                if whole:
                    put(fill + each * length, whole, pack + (length,) * each)
                    left -= whole * each
                    count -= whole
                if count and left:
                    put(fill + left * length, 1, pack + (length,) * left)
                    left, count = 0, count - 1
                if count:
                    open_packs[fill].append((count, pack))
        each = size // length
        if left >= each:
            put(each * length, left // each, (length,) * each)
        if left % each:
            put(left % each * length, 1, (length,) * (left % each))
    return full + [x for packs in open_packs.values() for x in packs]


def places(packs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence, copies, offset of the first copy, of each run of places; sorted by rank."""
    runs = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, pack in packs:
        at = 0
        k = 0
        while k < len(pack):
            length, copies = pack[k], 1
            while k + copies < len(pack) and pack[k + copies] == length:
                copies += 1
            runs[length].append((next_rank[length], sequence, copies, at))
            next_rank[length] += count * copies
            at += copies * length
            k += copies
        sequence += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, nth[, ids]); nth numbers the task's pieces of one length."""
    path = tokenizer or tokenizer_path()

    def run(batches):
        from pyspark import TaskContext

        encode = task_encoder(path, True)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows, held = [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    rows.append((doc_id, start, length, zlib.crc32(part), n, task, seen[length]))
                    if with_ids:
                        held.append(part)
                    seen[length] += 1
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                if with_ids:
                    columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, task int, nth bigint" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row for each piece."""
    cut = materialize(pieces(docs, tokenizer, size, end_id, with_ids), "pieces")
    counts = materialize(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = places(patterns(histogram, size))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_l"), F.col("task").alias("_t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(base, (F.col("length") == F.col("_l")) & (F.col("task") == F.col("_t"))).select(
        *[c for c in cut.columns if c not in ("task", "nth")], (F.col("base") + F.col("nth")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, bounds):
                if not len(rows):
                    continue
                n = int(length[rows[0]])
                first, seq, copies, begin = at[n]
                k = np.searchsorted(first, rank[rows], "right") - 1
                r = rank[rows] - first[k]
                sequence[rows] = seq[k] + r // copies[k]
                offset[rows] = begin[k] + r % copies[k] * n
            names = [f.name for f in batch.schema][:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1]]
    return ranked.mapInArrow(place, ", ".join([*kept, "sequence_id bigint", "offset bigint"]))


def assemble(packed: DataFrame, size: int = SIZE, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids array<bigint>, n_tokens) of pieces packed with_ids, padded to ``size`` except at a power of two; a sequence has at most ``size`` pieces."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    joined = packed.groupBy("sequence_id").agg(F.array_join(parts, "").alias("h"), F.sum("length").cast("int").alias("n_tokens"))
    byte = lambda i, k: F.conv(F.substring("h", i * 8 + 2 * k + 1, F.lit(2)), 16, 10).cast("bigint")
    ids = F.transform(F.sequence(F.lit(0), F.col("n_tokens") - 1), lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)
    even = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    missing = F.when(even, 0).otherwise(size - F.col("n_tokens"))
    return joined.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id).cast("bigint"), missing)).alias("ids"), "n_tokens")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
