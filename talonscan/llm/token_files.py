"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds consecutive documents. Each frame is a complete zstandard frame of whole documents' ids
(little-endian, 16 bit where the vocabulary fits, else 32) with a content checksum. Two skippable frames follow:
a document table (for each document its id, its number of ids, its frame) and a seek table in
the layout of the zstandard seekable format (compressed and raw size and checksum of each frame), so a reader
takes the tail, then decompresses only the frames of the documents that it wants.

Defined results: null text is the empty text (just the end id); rows are in ascending doc_id order, nulls
first, and rows of one doc_id in order of a hash of their text, all kept; other columns are ignored; an empty table gives
no files. A file that a lost or repeated task attempt leaves is not in the manifest and so is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.bpe import task_encoder, tokenizer_path
from talonscan.llm.common import materialize, shared_dir, table

END_ID = 2
FRAME_BYTES = 1 << 17
SKIPPABLE, DOC_MAGIC, SEEK_MAGIC = 0x184D2A5E, b"TSD1", 0x8F92EAB1
NO_ID = -(2**63)


class TokenWriter:
    """Writes documents to an open binary sink."""

    def __init__(self, sink, width: int = 4):
        self.sink, self.width = sink, width
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.held, self.size = [], 0
        self.frames, self.docs = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        raw = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids
        if self.held and self.size + len(raw) > FRAME_BYTES:
            self.flush()
        self.held.append(raw)
        self.size += len(raw)
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids) // 4, len(self.frames)))

    def flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        docs = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(np.array(self.docs, "<i8").reshape(-1, 3).tobytes())
        body = docs + struct.pack("<IB4s", len(self.docs), self.width, DOC_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        table_ = b"".join(struct.pack("<III", *f) for f in self.frames)
        body = table_ + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class TokenReader:
    """Random access to a token file (an open, seekable binary source)."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        seek_at = size - 9 - 12 * n
        entries = np.frombuffer(self._at(seek_at, 12 * n), "<u4").reshape(-1, 3)
        self.frames = entries
        self.frame_at = np.concatenate([[0], np.cumsum(entries[:, 0], dtype=np.int64)]).tolist()
        docs_at = self.frame_at[-1]
        length = struct.unpack("<II", self._at(docs_at, 8))[1]
        body = self._at(docs_at + 8, length)
        count, self.width, magic = struct.unpack("<IB4s", body[-9:])
        if magic != DOC_MAGIC:
            raise ValueError("no document table")
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[:-9]), "<i8").reshape(-1, 3)
        starts = np.cumsum(self.docs[:, 1]) - self.docs[:, 1]
        first = np.searchsorted(self.docs[:, 2], self.docs[:, 2])
        self.within = starts - starts[first] if count else starts
        self._frame = (-1, b"")

    def _at(self, where: int, n: int) -> bytes:
        self.source.seek(where)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self._frame[0] != k:
            packed = self._at(self.frame_at[k], int(self.frames[k, 0]))
            raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._frame = (k, raw)
        return self._frame[1]

    def document(self, n: int) -> np.ndarray:
        """Ids of the n-th document of the file."""
        _, size, k = self.docs[n].tolist()
        a = int(self.within[n]) * self.width
        return np.frombuffer(self.frame(k)[a : a + size * self.width], f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this id."""
        return [self.document(int(n)) for n in np.flatnonzero(self.docs[:, 0] == doc_id)]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes with the tokenizers library and writes files below ``folder`` in doc_id order.

    Ids take two bytes where the vocabulary fits, else four.
    Returns the manifest (shard int, path string, n_docs bigint, n_tokens bigint), one row for each file.
    """
    path = tokenizer or tokenizer_path()

    def run(batches):
        from pyspark import TaskContext

        encode = task_encoder(path, True)
        width = 2 if max(len(encode.model.opens), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        fs, where = pa.fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"{where}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        writer = sink = None
        docs_, tokens = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(where, recursive=True)
                sink = fs.open_output_stream(name)
                writer = TokenWriter(sink, width)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                writer.add(doc_id, ids + end)
                docs_ += 1
                tokens += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [docs_], "n_tokens": [tokens]})

    ordered = (
        docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("_h"))
        .repartitionByRange("doc_id", "_h")
        .sortWithinPartitions("doc_id", "_h")
        .select("doc_id", "text")
    )
    return ordered.mapInArrow(run, "shard int, path string, n_docs bigint, n_tokens bigint")


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): documents of the files, start counting the ids of all before.

    The driver sees one small row for each file.
    """
    rows, at = [], 0
    for r in manifest.select("shard", "path", "n_tokens").orderBy("shard").collect():
        rows.append((r.path, at))
        at += r.n_tokens
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    return _read(spark, rows, folder, "ids binary", lambda ids: ids.tobytes())


def _read(spark: SparkSession, rows, folder: str, column: str, shape) -> DataFrame:
    def run(batches):
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as source:
                    reader = TokenReader(source, source.size())
                    sizes = reader.docs[:, 1]
                    starts = base + np.cumsum(sizes) - sizes
                    for a in range(0, len(sizes), 2000):
                        b = min(len(sizes), a + 2000)
                        ids = [None if x == NO_ID else x for x in reader.docs[a:b, 0].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(starts[a:b]), pa.array(sizes[a:b]), pa.array([shape(reader.document(n)) for n in range(a, b)])],
                            ["doc_id", "start", "n_tokens", column.split(" ")[0]],
                        )

    files = spark.createDataFrame(rows, "path string, base bigint").repartition(len(rows))
    return files.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {column}")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = materialize(write_tokens(table(spark, sf_dir, "documents"), folder), "manifest")
    rows, at = [], 0
    for r in manifest.orderBy("shard").collect():
        rows.append((r.path, at))
        at += r.n_tokens
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return _read(spark, rows, folder, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()))
